from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.vectors import unit
from tallyforge.operators import dedup as E
from tallyforge.operators import similarity as S
from tallyforge.operators.components import connected_components


def test_exact_duplicates(spark):
    rows = [("a1", "f", "x", "t1"), ("a2", "f", "x", "t2"), ("a3", "g", "x", "t1"), ("a4", "g", "y", "t2"), ("a5", "g", "z", "t2")]
    found = {r["id"]: r for r in E.exact_duplicates(spark.createDataFrame(rows, "id string, field string, norm_name string, norm_text string")).collect()}
    assert {i for i, r in found.items() if r["dropped_name"]} == {"a2"} and found["a2"]["name_winner"] == "a1"
    assert {i: r["text_winner"] for i, r in found.items() if r["dropped_text"]} == {"a3": "a1", "a5": "a4"}  # a2 takes no part
    assert {i for i, r in found.items() if r["dropped_exact"]} == {"a2", "a3", "a5"}


@pytest.mark.parametrize("block", [4, 1024])
def test_similar_pairs_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    data = [(k, "ab"[k % 2], rng.normal(size=3).tolist()) for k in range(40)] + [(99, "a", None), (100, "a", [0.0] * 3)]
    found = {(r["a"], r["b"]): r["similarity"] for r in E.similar_pairs(spark.createDataFrame(data, "id int, field string, embedding array<double>"), 0.5, block=block).collect()}
    wanted = {}
    for i, f, v in data[:40]:
        for j, g, w in data[:40]:
            if i < j and f == g and (s := float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))) >= 0.5:
                wanted[i, j] = s
    assert found == pytest.approx(wanted) and wanted


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in parent}


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (777, 777)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == brute_components(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def replayed(nodes, similarity, seed):
    """The degree rule over a dense matrix."""
    ids, left, out = sorted(nodes), set(nodes), []
    while True:
        degree = {i: sum((min(i, j), max(i, j)) in similarity for j in left if j != i) for i in left}
        most = max(degree.values(), default=0)
        if not most:
            return out
        total = {i: np.sum(np.array([similarity.get((min(i, j), max(i, j)), 0) if j in left and j != i else 0 for j in ids], np.float32), dtype=np.float32) for i in left if degree[i] == most}
        top = max(total.values())
        gone = max((i for i in total if total[i] == top), key=lambda i: int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest(), 16))
        out.append(gone)
        left.remove(gone)


def test_degree_drop_against_replay():
    rng = random.Random(2)
    for _ in range(30):
        nodes = [f"n{k}" for k in range(rng.randrange(3, 9))]
        similarity = {(a, b): rng.choice([0.5, 0.75, 0.9]) for a in nodes for b in nodes if a < b and rng.random() < 0.6}
        found = E.degree_drop(nodes, [(a, b, s) for (a, b), s in similarity.items()], 42)
        assert [f[0] for f in found] == replayed(nodes, similarity, 42)
        assert [f[3] for f in found] == list(range(1, len(found) + 1))
    assert E.degree_drop(["a", "b"], [("a", "b", 0.9)], 42, 0)[0][:2] == ("a", "b")
    assert E.degree_drop(["a", "b"], [("a", "b", 0.9)], 42, 1)[0][:2] == ("b", "a")


def test_near_duplicates_and_invariants(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    data = [(f"v{k:02d}", "fg"[k % 2], (base[k % 6] + 0.2 * rng.normal(size=8)).tolist()) for k in range(30)]
    vectors = spark.createDataFrame(data, "id string, field string, embedding array<double>")
    for how in ("draw", "hash"):
        gone = E.near_duplicates_at(vectors, 0.8, tie_break=how)
        pairs = E.similar_pairs(vectors, 0.8)
        assert [r["violations"] for r in E.violations(pairs, gone, 0.8).collect()] == [0, 0]
        assert gone.count() > 0
    tools = spark.createDataFrame([(i, f, i == "v00") for i, f, _ in data] + [("w", "f", False)], "id string, field string, dropped_exact boolean")
    flags = E.drop_flags(tools, vectors, [0.8, 0.95], tie_break="hash")
    assert Counter(r["tau"] for r in flags.collect()) == {"0.8": 31, "0.95": 31}
    assert flags.where("id = 'w' and dropped").count() == 0 and flags.where("id = 'v00' and dropped").count() == 2


def test_pairs_of_two_take_the_generators_draws(spark):
    data = [(f"{f}{k}", f, [1.0, 0.1 * k]) for f in "abcdef" for k in range(2)]
    found = sorted(r["id"] for r in E.near_duplicates_at(spark.createDataFrame(data, "id string, field string, embedding array<double>"), 0.9).collect())
    draws = random.Random(42)
    assert found == [f"{f}{draws.choice([0, 1])}" for f in "abcdef"]


def test_statistics_by_brute_force(spark):
    rng = np.random.default_rng(7)
    data = [(k, f"g{k % 3}" if k < 12 else "alone", rng.normal(size=4).tolist()) for k in range(13)]
    found = {r["field"]: r for r in S.by_group(spark.createDataFrame(data, "id int, field string, embedding array<double>"), ["field"]).collect()}
    cosine = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    for g in {d[1] for d in data}:
        mine, others = [d for d in data if d[1] == g], [d for d in data if d[1] != g]
        within = [cosine(a[2], b[2]) for i, a in enumerate(mine) for b in mine[i + 1 :]]
        across = [cosine(a[2], b[2]) for a in mine for b in others]
        assert found[g]["count"] == len(mine)
        for name, values in (("within", within), ("vs_others", across)):
            for what, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max)):
                got = found[g][f"{name}_{what}"]
                assert got is None if not values else got == pytest.approx(f(values)), (g, name, what)


def test_unit_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(unit(F.col("v")).alias("u")).collect()
    assert [list(r["u"]) for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
