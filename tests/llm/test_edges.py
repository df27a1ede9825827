"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bagminhash, interleave, langid, lattice, lzprint, materialize, mixing, packing, repetition, toxicity
from tallyforge.llm.queries import QUERIES

from .messy import CLASHES, LONG, ROWS, crowded, empty, messy, sorted_rows

OPERATORS = {
    "mix": lambda d: mixing.mix(d, block_tokens=4, shards=2),
    "fingerprints": lzprint.fingerprints,
    "repetition": repetition.repetition,
    "lattice": lattice.score,
    "pack": packing.pack,
    "language": langid.identify,
    "interleave": interleave.interleave,
    "toxicity": toxicity.toxicity,
    "near duplicates": bagminhash.near_duplicates,
    "training order": materialize.training_order,
}
FILTERS = {
    "toxicity": toxicity.without_toxic,
    "language": langid.of_known_language,
    "near duplicates": bagminhash.without_near_duplicates,
    "mixture": lambda d: mixing.in_mixture(d, block_tokens=4, shards=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, name):
    docs = messy(spark)
    if name == "training order":  # its order follows files and rows
        docs = docs.coalesce(1)
    assert sorted_rows(OPERATORS[name](crowded(docs))) == sorted_rows(OPERATORS[name](docs))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(spark, name):
    found = OPERATORS[name](empty(spark))
    assert found.collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null_rows(spark, name):
    nothing = spark.createDataFrame([(None,) * 5] * 3, "doc_id int, text string, lang string, source string, n_chars int")
    expected = {"mix": 0, "pack": 0, "near duplicates": 0}.get(name, 3)
    assert OPERATORS[name](nothing).count() == expected


@pytest.mark.parametrize("name", ["fingerprints", "repetition", "lattice", "language", "interleave", "toxicity"])
def test_a_row_for_each_row(spark, name):
    found = OPERATORS[name](messy(spark)).select("doc_id").collect()
    assert sorted((r[0] for r in found), key=repr) == sorted((r[0] for r in ROWS), key=repr)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(spark, name):
    docs = crowded(messy(spark))
    kept = FILTERS[name](docs)
    assert kept.columns == docs.columns
    some = kept.first().asDict()
    assert all(some[c] == f"my {c}" for c in CLASHES)
    assert FILTERS[name](crowded(empty(spark))).collect() == []


def test_null_and_empty_texts(spark):
    docs = messy(spark)
    scored = {r["doc_id"]: r for r in lattice.score(docs).collect()}
    assert all(scored[i]["log_prob"] == 0 and scored[i]["bits_per_byte"] is None for i in (2, 3, 4))
    assert scored[5]["n_words"] == len(LONG.split())
    known = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(known[i]["language"] is None and not known[i]["keep"] for i in (2, 3, 4))
    toxic = {r["doc_id"]: r for r in toxicity.toxicity(docs).collect()}
    assert all(toxic[i]["score"] == 0 and not toxic[i]["toxic"] for i in (2, 3, 4, 5))
    shares = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    assert all(shares[i]["keep"] and shares[i]["dup_5gram"] == 0 for i in (2, 3, 4, 6))
    prints = {r["doc_id"]: r for r in lzprint.fingerprints(docs).collect()}
    assert {prints[i]["rep_id"] for i in (2, 3, 4)} == {2} and prints[9]["rep_id"] == 8
    copies = {r["doc_id"]: r for r in bagminhash.near_duplicates(docs).collect()}
    assert sorted(copies) == list(range(1, 11))
    assert {copies[i]["group_id"] for i in (2, 3, 4)} == {2} and copies[9]["group_id"] == 8 and not copies[9]["keep"]
    tokens = {}
    for r in packing.pack(docs).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens[5] == len(LONG.split()) and tokens[1] == 2 * 10 and not {2, 3, 4} & set(tokens)


def test_kept_rows_of_equal_and_null_names(spark):
    kept = bagminhash.without_near_duplicates(messy(spark))
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and ids.count(None) == 2 and 9 not in ids and {3, 4}.isdisjoint(ids)


def test_pipeline_on_messy_and_empty_documents(spark, tmp_path):
    for name, docs in (("messy", crowded(messy(spark))), ("empty", empty(spark))):
        docs.withColumn("doc_id", F.col("doc_id").cast("long")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert name == "messy" or found == []


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
