from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from tallyforge.llm import buckets
from tallyforge.llm import lzprint as Z
from tallyforge.llm.queries import QUERIES
from tallyforge.llm.words import steps


def lz78(words: list[str]) -> set[tuple[str, ...]]:
    known, now = set(), ()
    for w in words:
        now += (w,)
        if now not in known:
            known.add(now)
            now = ()
    return known


def test_phrases_are_those_of_lz78():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = rng.choice(list("abcd"), rng.integers(0, 200)).tolist()
        assert len(Z.phrases([ord(w) for w in words])) == len(lz78(words))
    assert lz78("a a b a b".split()) == {("a",), ("a", "b")}


def test_similarity_estimates_shared_phrases():
    rng = np.random.default_rng(4)
    base = rng.choice(3000, 800).tolist()
    other = base[:500] + rng.choice(3000, 300).tolist()
    texts = [" ".join(f"w{k}" for k in x) for x in (base, other)]
    (step,) = steps(pa.array(texts))
    _, found = Z.parsed(step)
    a, b = (lz78(t.split()) for t in texts)
    wanted = len(a & b) / len(a | b)
    assert abs((found[0] == found[1]).mean() - wanted) < 4 * 0.5 / np.sqrt(Z.SIZE)
    byte = Z.signatures(found)
    assert abs(Z.similarity((byte[0] == byte[1]).sum()) - wanted) < 4 * 0.5 / np.sqrt(Z.SIZE)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints, sizes = {}, {}
    for step in steps(pa.array([t for _, t in texts], pa.string())):
        known, found = Z.parsed(step)
        for k in range(step.n):
            prints[texts[step.first + k][0]], sizes[texts[step.first + k][0]] = found[k], len(known[k])
    rep = {}
    first: dict[bytes, int] = {}
    for i, p in prints.items():
        rep[i] = first.setdefault(p.tobytes(), i)
    reps = sorted(first.values())
    matrix = Z.signatures(np.array([prints[i] for i in reps]))
    wanted: dict[int, dict[int, float]] = {i: {} for i in reps}
    for x, i in enumerate(reps):
        share = Z.similarity((matrix == matrix[x]).sum(1))
        for y in np.flatnonzero(share >= Z.LEAST):
            if y != x and sizes[i] and sizes[reps[y]]:
                wanted[i][reps[y]] = share[y]
    found = {r["doc_id"]: r for r in Z.fingerprints(docs).collect()}
    assert {i: r["rep_id"] for i, r in found.items()} == rep
    assert {i: r["n_phrases"] for i, r in found.items()} == sizes
    hits = total = 0
    for i, r in found.items():
        partners = dict(zip(r["similar"], r["similarities"]))
        assert list(partners) == sorted(partners)
        assert all(abs(wanted[rep[i]][j] - s) < 1e-9 for j, s in partners.items())  # nothing false
        hits += len(partners)
        total += len(wanted[rep[i]])
    assert total and hits >= 0.9 * total


def test_matches_are_symmetric(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.choice(2000, 400)]
    rows = [(k, " ".join(base[: 400 - 10 * k])) for k in range(4)]
    found = {r["doc_id"]: set(r["similar"]) for r in Z.fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, j in itertools.permutations(found, 2):
        assert (j in found[i]) == (i in found[j])
    assert found[0]


def test_tiles_own_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.choice(2000, 300)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(300, k % 7, replace=False):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    whole = {r[0]: tuple(r) for r in Z.fingerprints(docs).collect()}
    monkeypatch.setattr(buckets, "BLOCK", 7)
    monkeypatch.setattr(buckets, "AT_ONCE", 50)
    assert {r[0]: tuple(r) for r in Z.fingerprints(docs).collect()} == whole
    assert sum(len(r[4]) for r in whole.values()) > 500
    for n, block in ((0, 3), (9, 3), (10, 20)):
        keys = np.repeat(np.arange(n), 5)
        found = [(a, b) for row, other in buckets.pairs(keys, np.zeros(keys.size, np.int64)) for a, b in zip(row.tolist(), other.tolist())]
        assert len(found) == len(set(found)) == 10 * n and all(b < a and keys[a] == keys[b] for a, b in found)
    crossed = [(a, b) for row, other in buckets.pairs(np.zeros(5, np.int64), np.array([2, 2, 4, 4, 4])) for a, b in zip(row.tolist(), other.tolist())]
    assert sorted(crossed) == [(a, b) for a in (2, 3, 4) for b in (0, 1)]


def test_links_are_those_of_the_lists(spark, sf_dir):
    near = f"{sf_dir}/../sf0.01"
    listed = {r["doc_id"]: r for r in Z.fingerprints(spark.read.parquet(f"{near}/documents.parquet")).collect()}
    least = {i: r["rep_id"] for i, r in listed.items()}
    while True:  # the lowest doc_id that each leads to
        now = {i: min([least[r["rep_id"]], *(least[j] for j in r["similar"])]) for i, r in listed.items()}
        if now == least:
            break
        least = now
    found = {r["doc_id"]: r for r in QUERIES["op2_lz_fingerprints"](spark, near).collect()}
    assert {i: tuple(r)[:4] for i, r in found.items()} == {i: tuple(r)[:4] for i, r in listed.items()}
    assert {i: r["links"] for i, r in found.items()} == {i: len(r["similar"]) for i, r in listed.items()}
    assert {i: r["class_id"] for i, r in found.items()} == least
    assert sum(r["links"] for r in found.values()) > 100 and any(least[i] < r["rep_id"] for i, r in listed.items())


def test_near_copies_are_counted_not_listed(spark, tmp_path):
    """n near copies have n * (n - 1) links; neither a step nor the result has as many rows or items."""
    rng = np.random.default_rng(8)
    one = rng.integers(0, 256, Z.SIZE, np.uint8)
    all_ = np.repeat(one[None], 300, 0)
    all_[np.arange(300), rng.integers(5, Z.SIZE, 300)] ^= 1
    tile = (np.arange(300) + 7, np.zeros(300, np.int64), np.zeros(300, np.int32), np.zeros(300, np.int32), all_)
    (batch,) = Z._counted(tile)
    assert batch.num_rows == 300 and set(batch.column("links").to_pylist()) == {299} and set(batch.column("b").to_pylist()) == {7}
    base = [f"w{k}" for k in rng.choice(5000, 400)]
    rows = [(k, " ".join([*base[: k * 3], f"x{k}", *base[k * 3 + 1 :]])) for k in range(80)]
    rows += [(100 + k, rows[0][1]) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op2_lz_fingerprints"](spark, str(tmp_path))
    assert not [c for c, kind in found.dtypes if kind.startswith("array")]
    by = {r["doc_id"]: r for r in found.collect()}
    assert len(by) == 120 and {r["class_id"] for r in by.values()} == {0} and {by[k]["rep_id"] for k in range(100, 140)} == {0}
    reps = {r["rep_id"] for r in by.values()}
    assert len(reps) > 30 and {r["links"] for r in by.values()} == {len(reps) - 1}


def test_each_text_of_a_repeated_name_has_its_own_links(spark):
    rng = np.random.default_rng(5)
    one, two = ([f"{c}{k}" for k in rng.choice(3000, 300)] for c in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:-3], "y"])), (3, " ".join([*two[:-3], "y"])), (4, " ".join([*two[:-2], "z"])), (None, " ".join([*one[:-2], "z"])), (5, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    found = sorted((r["doc_id"] or 0, r["links"], r["rep_id"] or 0, r["class_id"] or 0) for r in Z.linked(docs).collect())
    assert found == [(0, 0, 0, 0), (0, 0, 5, 5), (1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 2, 1), (3, 2, 3, 1), (4, 2, 4, 1), (5, 0, 5, 5)]
    assert Z.linked(docs.limit(0)).collect() == []
