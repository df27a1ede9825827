from __future__ import annotations

import os
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import materialize as M
from tallyforge.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32 - 1))
def test_feistel_is_a_permutation(n, key):
    assert sorted(M.feistel(np.arange(n), n, key).tolist()) == list(range(n))


def test_feistel_depends_on_the_key():
    assert (M.feistel(np.arange(1000), 1000, 1) != M.feistel(np.arange(1000), 1000, 2)).mean() > 0.9
    assert np.corrcoef(np.arange(100_000), M.feistel(np.arange(100_000), 100_000, 1))[0, 1] < 0.02


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with open(M.VOCABULARY, "rb") as f:
        decode = M.encoder(f.read()).decode
    found = M.training_order(docs).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    ids: dict[int, dict[int, list[int]]] = {}
    for r in found:
        assert len(r["record"]) == 2 * M.LENGTH
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // M.PER_SHARD, r["slot"] % M.PER_SHARD * 2 * M.LENGTH)
        ids.setdefault(r["doc_id"], {})[r["seq"]] = np.frombuffer(r["record"], "<u2")[: r["n_tokens"]].tolist()
    for r in docs.select("doc_id", "text").collect():
        parts = ids.pop(r["doc_id"])
        assert sorted(parts) == list(range(len(parts)))
        tokens = [t for k in sorted(parts) for t in parts[k]]
        assert tokens[-1] == M.END and decode(tokens[:-1]) == (r["text"] or "")
    assert not ids


def test_shards_are_read_in_order_and_resumed(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ordered = M.training_order(docs, length=64, per_shard=500).cache()
    folder = str(tmp_path / "out")
    manifest = M.write_shards(ordered, folder, 64, 500)
    assert manifest["written"] == manifest["sequences"] == ordered.count()
    wanted = {r["slot"]: r["record"] for r in ordered.select("slot", "record").collect()}
    read = [s.tobytes() for s in M.read_sequences(folder)]
    assert read == [bytes(wanted[k]) for k in range(len(wanted))]
    assert [s.tobytes() for s in M.read_sequences(folder, 733)] == read[733:]
    os.remove(f"{folder}/shard-000001.bin")
    again = M.write_shards(ordered, folder, 64, 500)
    assert again["written"] == 500 and [s.tobytes() for s in M.read_sequences(folder)] == read
    ordered.unpersist()


def test_same_key_same_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = ([tuple(r)[:5] for r in M.training_order(docs).orderBy("slot").collect()] for _ in range(2))
    assert one == two


def test_query_writes_the_shards_it_names(spark, sf_dir):
    found = sorted(QUERIES["op10_training_order"](spark, sf_dir).collect())
    ordered = M.training_order(spark.read.parquet(f"{sf_dir}/documents.parquet")).orderBy("slot").collect()
    assert [r[:2] + (r["doc_id"], r["seq"], r["n_tokens"]) for r in found] == [(r["slot"], r["shard"], r["doc_id"], r["seq"], r["n_tokens"]) for r in ordered]
    for r, wanted in zip(found, ordered):
        with open(r["file"], "rb") as f:
            f.seek(r["byte_offset"])
            assert (record := f.read(2 * M.LENGTH)) == bytes(wanted["record"]) and zlib.crc32(record) == r["checksum"]
    assert [s.tobytes() for s in M.read_sequences(os.path.dirname(found[0]["file"]))] == [bytes(r["record"]) for r in ordered]


def test_shards_of_another_key_are_replaced(spark, sf_dir, tmp_path):
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "out")
    for key in (1, 2):
        ordered = M.training_order(docs, length=64, per_shard=500, key=key).cache()
        assert M.write_shards(ordered, folder, 64, 500)["written"] == ordered.count()
        assert [s.tobytes() for s in M.read_sequences(folder)] == [bytes(r["record"]) for r in ordered.orderBy("slot").collect()]
        ordered.unpersist()


def test_resuming_with_another_key_and_other_partitions(spark, sf_dir, tmp_path):
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "out")
    first = M.training_order(docs.coalesce(1), length=64, per_shard=500, key=1).cache()
    begun = M.write_shards(first, folder, 64, 500)
    read = [s.tobytes() for s in M.read_sequences(folder, digest=begun["digest"])]
    os.remove(f"{folder}/shard-000002.bin")
    second = M.training_order(docs.repartition(5, "doc_id"), length=64, per_shard=500, key=2).cache()
    other = M.write_shards(second, folder, 64, 500)
    again = [s.tobytes() for s in M.read_sequences(folder)]
    assert again == [bytes(r["record"]) for r in second.orderBy("slot").collect()] and sorted(again) == sorted(read)
    assert other["digest"] != begun["digest"]
    with pytest.raises(ValueError, match="another order"):
        next(M.read_sequences(folder, 700, begun["digest"]))
    assert M.write_shards(first, folder, 64, 500)["digest"] == begun["digest"]
    for x in (first, second):
        x.unpersist()


def by_hand(index: int, n: int, key: int) -> int:
    """The Feistel network in plain numbers, walking the cycle until it falls below n."""
    word = (1 << 64) - 1

    def mixed(x: int) -> int:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return x ^ x >> 31

    half = 1
    while 1 << 2 * half < n:
        half += 1
    while True:
        left, right = index >> half, index & (1 << half) - 1
        for k in range(M.ROUNDS):
            left, right = right, left ^ mixed(right ^ mixed(k + key * 0x9E3779B97F4A7C15 & word)) & (1 << half) - 1
        index = left << half | right
        if index < n:
            return index


def test_query_against_brute_force(spark, sf_dir):
    """Slot, shard, offset and record of every sequence, from the texts in the order of the file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    with open(M.VOCABULARY, "rb") as f:
        encode = M.encoder(f.read()).encode_ordinary
    sequences = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = [*encode(text or ""), M.END]
        sequences += [(doc_id, k // M.LENGTH, ids[k : k + M.LENGTH]) for k in range(0, len(ids), M.LENGTH)]
    wanted = {}
    for number, (doc_id, seq, ids) in enumerate(sequences):
        slot = by_hand(number, len(sequences), M.KEY)
        record = np.array(ids + [M.END] * (M.LENGTH - len(ids)), "<u2").tobytes()
        wanted[slot] = (slot // M.PER_SHARD, slot % M.PER_SHARD * 2 * M.LENGTH, doc_id, seq, len(ids), record)
    found = {r["slot"]: (*tuple(r)[1:6], bytes(r["record"])) for r in M.training_order(docs).collect()}
    assert found == wanted


def test_shards_are_shuffled_a_part_at_a_time(spark, sf_dir, tmp_path, monkeypatch):
    """Each part has no more than its shards, and its shuffle files are gone before the next."""
    docs, sizes, real = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], M.written
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        found = blocks.getAllFiles()
        files = [found.apply(k) for k in range(found.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}

    def written(df, name):
        before = shuffled()
        path = real(df, name)
        if name == "slots":
            sizes.append(spark.read.parquet(path).count())
            for _ in range(100):
                if (left := sum(n for f, n in shuffled().items() if f not in before)) < sizes[-1]:  # a byte a record
                    break
                time.sleep(0.1)
            assert left < sizes[-1]
        return path

    monkeypatch.setattr(M, "written", written)
    kept = spark.conf.get(M._CLEANUP)
    found = M.materialised(docs, str(tmp_path / "out"), length=64, per_shard=500).orderBy("slot").collect()
    shards = -(-len(found) // 500)
    assert spark.conf.get(M._CLEANUP) == kept and shards > 4
    assert 1 < len(sizes) <= M.WAVES and sum(sizes) == len(found) and max(sizes) <= -(-shards // M.WAVES) * 500
    ordered = M.training_order(docs, length=64, per_shard=500).orderBy("slot").collect()
    assert [(r["slot"], r["shard"], r["byte_offset"], r["doc_id"], r["seq"]) for r in found] == [tuple(r)[:5] for r in ordered]
    assert [x.tobytes() for x in M.read_sequences(str(tmp_path / "out"))] == [bytes(r["record"]) for r in ordered]
