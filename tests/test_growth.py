"""Work and memory that must not grow faster than the input (round 3)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import dedup as E
from tallyforge.operators import reliability as R
from tallyforge.operators import similarity as S
from tallyforge.plans.catalog import QUERIES

from .measuring import most_rows
from .test_dedup import brute_components


def test_tools_meet_one_file_of_a_name(spark):
    tools = spark.range(300).select(F.col("id").alias("tool_id"), F.lit("My Tool").alias("tool_name"), (F.col("id") + 200).alias("spec"))
    files = spark.range(300).select(F.concat(F.lit("f_tool_spec_"), "id", F.lit("__My_Tool__output.json")).alias("path"))
    odd = spark.createDataFrame([("a__My_Tool__output.json",), ("f_tool_spec_7__Other__output.json",), ("e_tool_spec_299__My_Tool__output.json",)], "path string")
    found = R.metadata_files(tools, files.union(odd))
    assert most_rows(found) < 1000  # all files of the name would be 300 x 302
    # the file without a spec number is the first by path, as in the SQL of metadata_preferred; of two of the own spec the first by path
    wanted = {i: f"{'e' if i == 99 else 'f'}_tool_spec_{i + 200}__My_Tool__output.json" if i < 100 else "a__My_Tool__output.json" for i in range(300)}
    assert {r["tool_id"]: r["path"] for r in found.collect()} == wanted


def _unit_rows(n: int, copies: int, seed: int) -> np.ndarray:
    v = np.random.default_rng(seed).normal(size=(n, 8))
    v[n - copies :] = v[:copies]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("tau", [0.2, 0.6, 0.95])
def test_degree_rule_of_vectors_is_that_of_their_pairs(tau, monkeypatch):
    monkeypatch.setattr(E, "KEPT", 500)  # rows of products go and are made again
    v = _unit_rows(300, 20, 5)
    names = [f"n{k}" for k in range(300)]
    products = v @ v.T
    edges = [(names[a], names[b], products[a, b]) for a in range(300) for b in range(a + 1, 300) if products[a, b] >= tau]
    wanted, found = E.degree_drop(names, edges, 42), E.degree_drop_of_vectors(names, v, tau, 42)
    assert [(f[0], f[3]) for f in found] == [(w[0], w[3]) for w in wanted] and wanted
    assert [f[2] for f in found] == pytest.approx([w[2] for w in wanted])
    assert E.degree_drop_of_vectors(["b", "a"], v[:2], -1.0, 42, 0)[0][:2] == ("a", "b")


def test_components_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_EDGES", 10, raising=False)
    v = _unit_rows(400, 30, 6)
    data = [(k, "fg"[k % 2], v[k].tolist()) for k in range(400)]
    vectors = spark.createDataFrame(data, "id long, field string, embedding array<double>")
    some = E.spanning_pairs(vectors, [0.5, 0.9], block=64)
    for k, tau in enumerate((0.5, 0.9)):
        pairs = [(r["a"], r["b"]) for r in E.similar_pairs(vectors, tau, block=64).collect()]
        few = [(r["a"], r["b"]) for r in some.where(F.col("k") == k).collect()]
        assert brute_components(few) == brute_components(pairs)
        assert {tuple(sorted(p)) for p in few} <= set(pairs) and (tau > 0.5 or len(few) < len(pairs) / 2)
    # a component of more pairs than one task took
    gone = E.near_duplicates_at(vectors, 0.5, tie_break="hash")
    assert gone.count() > 300 and [r["violations"] for r in E.violations(E.similar_pairs(vectors, 0.5), gone, 0.5).collect()] == [0, 0]


def test_an_id_of_two_fields_links_their_components(spark):
    data = [(1, "f", [1.0, 0.0]), (2, "f", [1.0, 0.1]), (2, "g", [0.0, 1.0]), (3, "g", [0.1, 1.0]), (4, "g", [1.0, 0.05])]
    gone = E.near_duplicates_at(spark.createDataFrame(data, "id int, field string, embedding array<double>"), 0.9).collect()
    assert [(r["id"], r["best_neighbor"], r["step"]) for r in gone] in ([("2", "1", 1)], [("2", "3", 1)])


def test_statistics_send_a_row_to_a_bounded_number_of_places(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 4))
    groups = np.sort(rng.integers(0, 7, 600))
    groups[:2] = 100, 101  # groups of one row
    vectors = spark.createDataFrame([(k, int(groups[k]), v[k].tolist()) for k in range(600)], "id int, field int, embedding array<double>")
    found = S.by_group(vectors, ["field"], block=4)  # 150 blocks of four rows before
    assert most_rows(found) <= 16 * 600
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    products = u @ u.T
    for r in found.collect():
        mine = groups == r["field"]
        within, others = products[np.ix_(mine, mine)][np.triu_indices(mine.sum(), 1)], products[np.ix_(mine, ~mine)]
        assert (r["within_mean"] is None) == (mine.sum() == 1)
        for name, x in (("within", within), ("vs_others", others)):
            if x.size:
                assert [r[f"{name}_{k}"] for k in ("mean", "std", "min", "max")] == pytest.approx([x.mean(), x.std(), x.min(), x.max()])
    assert S.overall(vectors, block=4).first()["mean"] == pytest.approx(products[np.triu_indices(600, 1)].mean())


def test_tiles_of_runs_cover_all_rows():
    for sizes in ([1], [5000], [1] * 3000, [200, 300, 3000, 1, 255, 256, 1024, 1025]):
        names = np.repeat(np.arange(len(sizes)), sizes)
        cut = S._runs(names)
        assert np.concatenate(cut).tolist() == list(range(len(names))) and max(map(len, cut)) <= S.TILE
    assert S._runs(np.zeros(0)) == []


@pytest.mark.parametrize("name", ["environment_tasks", "literal_yaml", "tools_keys", "travel_calls", "travel_changes"])
def test_parsers_of_one_small_file_run_on_all_cores(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
