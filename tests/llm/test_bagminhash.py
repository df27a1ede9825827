from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import bagminhash as B
from tallyforge.llm.words import steps


def bags_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for step in steps(pa.array(texts, pa.string())):
        doc, feature, times = B.bags(step)
        out += [(feature[doc == i], times[doc == i]) for i in range(step.n)]
    return out


def jaccard(a: dict, b: dict) -> float:
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for heavy in (3, 200):
        a = {int(f): int(w) for f, w in zip(rng.choice(1 << 40, 80, replace=False), rng.integers(1, heavy, 80))}
        b = {f: int(max(1, w + rng.integers(-heavy // 3, heavy // 3 + 1))) for f, w in list(a.items())[:60]} | {int(f): 2 for f in rng.choice(1 << 40, 15)}
        doc = np.repeat([0, 1], [len(a), len(b)])
        size = 8192
        found = B.signatures(doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, size)
        assert abs((found[0] == found[1]).mean() - jaccard(a, b)) < 4 * 0.5 / np.sqrt(size)


def test_overlap_is_weighted_jaccard():
    texts = ["a b a b a b c", "a b a b c d", "", "x", None, "a b"]
    bags = bags_of(texts)
    for (x, y) in itertools.product(bags, bags):
        wanted = jaccard(dict(zip(x[0].tolist(), x[1].tolist())), dict(zip(y[0].tolist(), y[1].tolist())))
        assert B.overlap(x, y) == pytest.approx(wanted if x[0].size or y[0].size else 1.0)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    bags = dict(zip([i for i, _ in texts], bags_of([t for _, t in texts])))
    # greedy in order of doc_id over all pairs
    stays: list[int] = []
    wanted: dict[int, int] = {}
    for i in bags:
        best = max(((B.overlap(bags[i], bags[j]), -j) for j in stays), default=(0.0, 0))
        if best[0] >= B.LEAST:
            wanted[i] = -best[1]
        else:
            wanted[i] = i
            stays.append(i)
    found = {r["doc_id"]: r for r in B.near_duplicates(docs).collect()}
    assert sorted(found) == sorted(bags)
    gone = {i for i, j in wanted.items() if i != j}
    caught = {i for i, r in found.items() if not r["keep"]}
    assert len(gone & caught) >= 0.9 * len(gone)
    for i, r in found.items():  # whatever goes has a verified copy that stays
        assert r["keep"] == (r["group_id"] == i)
        assert found[r["group_id"]]["keep"]
        assert r["similarity"] == pytest.approx(B.overlap(bags[i], bags[r["group_id"]]))
        assert r["similarity"] >= B.LEAST


def test_planted_copies(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for g in range(40):
        base = rng.choice(vocabulary, 120).tolist()
        for c in range(4):
            text = list(base)
            for k in rng.choice(120, 4 * c, replace=False):
                text[k] = str(rng.choice(vocabulary))
            rows.append((g * 4 + c, " ".join(text)))
    found = {r["doc_id"]: r["group_id"] for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(found[g * 4] == g * 4 for g in range(40))
    assert sum(found[i] == i // 4 * 4 for i in found) >= 0.95 * len(found)
