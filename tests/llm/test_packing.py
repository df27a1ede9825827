from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.functions.tokens import word_count
from tallyforge.llm import packing as P


def naive(lengths: list[int], capacity: int) -> list[list[int]]:
    """The same rule, by trying everything."""
    left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out = []
    while left:
        gap, one = capacity, []
        while fits := [i for i in left if lengths[i] <= gap]:
            one.append(fits[0])
            left.remove(fits[0])
            gap -= lengths[fits[0]]
        small = one[-1]
        room = gap + lengths[small]
        pairs = [(lengths[i] + lengths[j], -min(lengths[i], lengths[j])) for x, i in enumerate(left) for j in left[x + 1 :] if lengths[small] < lengths[i] + lengths[j] <= room]
        if gap and pairs:
            both, short = max(pairs)
            one.pop()
            left.append(small)
            left.sort(key=lambda i: (-lengths[i], i))
            for n in sorted((-short, both + short), reverse=True):
                i = next(i for i in left if lengths[i] == n)
                one.append(i)
                left.remove(i)
        out.append(one)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_against_trying_everything(lengths):
    found = P.best_two_fit(lengths, 30)
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 30 for b in found)
    assert found == naive(lengths, 30)


def test_two_that_fit_more_tightly_replace_the_smallest():
    assert [sorted([7, 2, 5, 4][i] for i in b) for b in P.best_two_fit([7, 2, 5, 4], 16)][0] == [4, 5, 7]


def test_query_packs_every_token_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {r[0]: r[1] for r in docs.select("doc_id", word_count(docs["text"])).collect()}
    found = P.pack(docs).collect()
    bins = Counter()
    slices: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        bins[r["bin_id"]] += r["n_tokens"]
        slices.setdefault(r["doc_id"], []).append((r["token_from"], r["n_tokens"]))
    assert max(bins.values()) <= P.CAPACITY
    for i, n in sizes.items():
        at = 0
        for start, length in sorted(slices.get(i, [])):
            assert start == at
            at += length
        assert at == n
    assert sum(bins.values()) > 0.97 * P.CAPACITY * len(bins)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = sorted((r[0], r[1]) for r in docs.select("doc_id", word_count(docs["text"])).collect() if r[1])
    rest = [(i, n // P.CAPACITY * P.CAPACITY, n % P.CAPACITY) for i, n in sizes if n % P.CAPACITY]
    wanted = {(k, p, *rest[i]) for k, b in enumerate(naive([n for _, _, n in rest], P.CAPACITY)) for p, i in enumerate(b)}
    whole = Counter((i, k * P.CAPACITY) for i, n in sizes for k in range(n // P.CAPACITY))
    found = P.pack(docs).collect()
    assert {tuple(r) for r in found if r["n_tokens"] < P.CAPACITY} == {w for w in wanted if w[-1] < P.CAPACITY}
    assert Counter((r["doc_id"], r["token_from"]) for r in found if r["n_tokens"] == P.CAPACITY) == whole


def test_large_and_null_ids_stay_as_they_are(spark):
    ids = [None, 2**60 + 1, 2**60 + 3, 2**63 - 1, -(2**62) - 1, None, 7]
    docs = spark.createDataFrame([(i, "w " * (5 + k)) for k, i in enumerate(ids)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_tokens"]) for r in P.pack(docs, group=3).collect()), key=repr)
    assert found == sorted(((i, 5 + k) for k, i in enumerate(ids)), key=repr)
    assert dict(P.pack(docs).dtypes)["doc_id"] == "bigint"
