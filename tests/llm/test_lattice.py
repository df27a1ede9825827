from __future__ import annotations

import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import lattice as L

LOG_P = {p: math.log(w) for p, w in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "ba": 0.1, "aba": 0.02, "<0x63>": 0.03, "<0xC3>": 0.01, "<0xA9>": 0.01, "<0x9F>": 0.01, "<0xE8>": 0.01, "<0xAA>": 0.01, "<0x9E>": 0.01}.items()}
needs_model = pytest.mark.skipif(not os.path.exists(L.MODEL), reason="no vocabulary")


def ways(word: str) -> list[list[str]]:
    """All segmentations; a character that is no piece is its bytes."""
    if not word:
        return [[]]
    out = [[p, *rest] for n in range(1, len(word) + 1) if (p := word[:n]) in LOG_P for rest in ways(word[n:])]
    if word[0] not in LOG_P:
        out += [[*(f"<0x{b:02X}>" for b in word[0].encode()), *rest] for rest in ways(word[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("abcé", min_size=1, max_size=8))
def test_forward_sums_all_segmentations(text):
    word = "▁" + text
    total = sum(math.exp(sum(LOG_P[p] for p in w)) for w in ways(word))
    assert math.exp(L.Lattice(LOG_P).forward(word)[-1]) == pytest.approx(total)


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", min_size=1, max_size=7))
def test_expected_counts_are_posteriors(text):
    word = "▁" + text
    all_ = [(w, math.exp(sum(LOG_P[p] for p in w))) for w in ways(word)]
    total = sum(p for _, p in all_)
    counts = L.defaultdict(float)
    L.Lattice(LOG_P).expected(word, 3, counts)
    wanted = L.defaultdict(float)
    for w, p in all_:
        for piece in w:
            wanted[piece] += 3 * p / total
    assert dict(counts) == pytest.approx(dict(wanted))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcéß語", min_size=1, max_size=12), max_size=12))
def test_table_equals_one_word_at_a_time(words):
    lattice, table = L.Lattice(LOG_P), L.Table(LOG_P)
    table.CELLS = 30
    assert table.log_probs(words).tolist() == pytest.approx([lattice.forward("▁" + w)[-1] for w in words])
    one, many = L.defaultdict(float), L.defaultdict(float)
    for k, w in enumerate(words, 1):
        lattice.expected("▁" + w, k, one)
    table.expected(words, L.np.arange(1, len(words) + 1), many)
    assert {p: n for p, n in many.items() if n > 1e-12} == pytest.approx({p: n for p, n in one.items() if n > 1e-12})


@needs_model
def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log_p = L.estimated(docs, L.vocabulary())
    assert sum(map(math.exp, log_p.values())) == pytest.approx(1)
    lattice = L.Lattice(log_p)
    found = {r["doc_id"]: r for r in L.score(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for i, text in rows:
        words = (text or "").split()
        wanted = sum(lattice.forward("▁" + w)[-1] for w in words)
        assert found[i]["log_prob"] == pytest.approx(wanted)
        assert found[i]["n_words"] == len(words)


@needs_model
def test_one_step_of_estimation_raises_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    before = L.vocabulary()
    after = L.estimated(docs, before)
    words = [w for r in docs.select("text").collect() for w in (r[0] or "").split()][:3000]
    one, two = L.Lattice(before), L.Lattice(after)
    assert sum(two.forward("▁" + w)[-1] for w in words) > sum(one.forward("▁" + w)[-1] for w in words)
