"""Training-order materialisation: token ids as fixed-size records in a keyed order."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import xor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir, written
from .words import mixed

VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a sequence; sequences of a shard (32 MiB); key of the order.
LENGTH, PER_SHARD, KEY = 512, 32_768, 0x5EED_0F0D
#: With more files than this the table of their offsets is joined, not broadcast (it has some 100 bytes a file).
FILES_TO_BROADCAST = 50_000
ROUNDS = 6
#: materialised() shuffles and writes the shards in so many parts, one after the other, as all records of a shuffle lie on disk at once.
WAVES = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each index below n in a keyed permutation of 0 .. n - 1.

    A balanced Feistel network permutes the numbers below the next power of 4; one that falls on n or
    above is put in again until it falls below (cycle-walking), which keeps it a permutation.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = index.astype(np.uint64).copy()
    todo = np.arange(out.size)
    while todo.size:
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def encoder(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """(doc_id, seq, n_tokens, record): each text's ids and an end id, cut every length tokens; a record is length
    little-endian 16-bit ids, filled up with end ids that n_tokens doesn't count."""
    with open(vocabulary, "rb") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(given.value).encode_ordinary
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for start in range(0, len(ids), 256):
                doc, seq, n, records = [], [], [], []
                for i in range(start, min(start + 256, len(ids))):
                    tokens = np.array([*encode(texts[i].as_py() or ""), END], "<u2")
                    count = -(-tokens.size // length)
                    record = np.full(count * length, END, "<u2")
                    record[: tokens.size] = tokens
                    doc += [ids[i]] * count
                    seq += range(count)
                    n += [length] * (count - 1) + [tokens.size - (count - 1) * length]
                    records.append(record.tobytes())
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(doc), [None, pa.py_buffer(b"".join(records))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), raw], ["doc_id", "seq", "n_tokens", "record"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, seq int, n_tokens int, record binary")


def _placed(docs: DataFrame, vocabulary: str, length: int, per_shard: int, key: int) -> tuple[DataFrame, int]:
    """The sequences, from a table in the shared folder, with slot and shard; and how many there are."""
    spark = docs.sparkSession
    table = spark.read.parquet(written(tokenised(docs, vocabulary, length), "sequences"))
    table = table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = table.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    offsets = files.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    sizes = offsets.agg(F.count(F.lit(1)).alias("files"), F.max("__before").alias("last")).crossJoin(files.agg(F.sum("__n").alias("rows"))).first()
    total = int(sizes["rows"] or 0)
    if sizes["files"] <= FILES_TO_BROADCAST:
        offsets = F.broadcast(offsets)
    place = F.pandas_udf(lambda index: pd.Series(feistel(index.to_numpy(np.int64), total, key)), "long")
    placed = table.join(offsets, "__file").withColumn("slot", place(F.col("__before") + F.col("__row")))
    return placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")), total


def _ordered(placed: DataFrame, first: int, shards: int, length: int, per_shard: int) -> DataFrame:
    """The slots of so many shards from first on, with a partition for each shard, in order."""
    return (
        placed.where(F.col("shard").between(first, first + shards - 1))
        .repartitionById(shards, F.col("shard") - first)
        .sortWithinPartitions("slot")
        .select("slot", "shard", (F.col("slot") % per_shard * 2 * length).alias("byte_offset"), "doc_id", "seq", "n_tokens", "record")
    )


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq, n_tokens, record): every sequence at its place in the training order.

    Texts are tokenised once, into a table in the shared folder; a sequence's number is its place there (input
    files and rows in order), and a keyed Feistel permutation with cycle-walking of those numbers is its slot, from 0 without gaps. A
    partition holds the per_shard slots of one shard, in order; record has 2 * length bytes and lies at byte_offset of
    its shard. The same files, split alike, and the same key give the same order.

    Null and empty texts are a sequence of one end id. Rows of equal or null doc_id have sequences of their
    own. No documents: no rows. Other columns are not looked at.
    """
    placed, total = _placed(docs, vocabulary, length, per_shard, key)
    return _ordered(placed, 0, max(1, -(-total // per_shard)), length, per_shard)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _shard(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.bin"


_SLOTS = "slot long, shard int, file string, byte_offset long, doc_id long, seq int, n_tokens int, checksum long, __written boolean"


def _shards(ordered: DataFrame, folder: str, length: int, per_shard: int) -> DataFrame:
    """The slots of ordered, whose evaluation writes the shards: one task holds and writes one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        shard, first = table.column("shard")[0].as_py(), table.column("slot")[0].as_py()
        records = [r.as_buffer() for r in table.column("record")]
        if first != shard * per_shard or table.column("shard")[-1].as_py() != shard or any(len(r) != 2 * length for r in records):
            raise ValueError(f"a partition must hold the slots of one shard of {per_shard} records of {2 * length} bytes: slot {first} of shard {shard}")
        data, name = b"".join(records), _shard(root, shard)
        there = False
        if system.get_file_info(name).size == len(data):
            with system.open_input_stream(name) as f:
                there = f.read() == data
        if not there:
            temporary = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(data)
            system.move(temporary, name)
        n = len(records)
        out = {c: table.column(c) for c in ("slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens")}
        out |= {"file": pa.array([_shard(folder, shard)] * n), "checksum": pa.array([zlib.crc32(r) for r in records], pa.int64()), "__written": pa.array([not there] * n)}
        names = [c.split()[0] for c in _SLOTS.split(", ")]
        yield from pa.table([out[c] for c in names], names).to_batches()

    return ordered.mapInArrow(run, _SLOTS)


def _manifest(slots: DataFrame, folder: str, length: int, per_shard: int) -> dict:
    done = slots.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__written").cast("long")).alias("written"), F.bit_xor(F.xxhash64("slot", "checksum")).alias("digest")).collect()
    manifest = {"sequences": sum(r["n"] for r in done), "length": length, "per_shard": per_shard, "shards": len(done), "written": sum(r["written"] for r in done)}
    manifest["digest"] = f"{reduce(xor, (r['digest'] for r in done), 0) % (1 << 64):016x}"
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/manifest.json.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(json.dumps(manifest).encode())
    system.move(temporary, f"{root}/manifest.json")
    return manifest


def _without_manifest(folder: str) -> None:
    """Takes the manifest of an earlier run away, so that nobody reads old and new shards as one order."""
    system, root = _filesystem(folder)
    if system.get_file_info(f"{root}/manifest.json").is_file:
        system.delete_file(f"{root}/manifest.json")


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> dict:
    """Writes what training_order() gives as one file a shard, and manifest.json; returns the manifest.

    folder is one that all executors share. A shard that is there already with the same bytes is not written again, so a run that
    was broken off goes on where it ended; one of another key, vocabulary or corpus is replaced, whatever its size. A shard appears under
    its name only when it is whole, the manifest only when all shards are there. Its digest is of all slots and their contents:
    another order, whatever made it another, has another digest.
    """
    _without_manifest(folder)
    return _manifest(_shards(ordered, folder, length, per_shard), folder, length, per_shard)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialised(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """(slot, shard, file, byte_offset, doc_id, seq, n_tokens, checksum): the training order, written as shards.

    Writes what training_order() gives as write_shards() does, into folder, by default a new one in the shared folder, for
    read_sequences(), in WAVES parts whose shuffle files are removed before the next. Sequence slot is the 2 * length bytes of file from
    byte_offset on; checksum is their CRC-32. Nulls, empty texts, repeated doc_ids and no documents: as training_order() states.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/').removeprefix('file:')}/training-order-{uuid.uuid4().hex}"
    _without_manifest(folder)
    placed, total = _placed(docs, vocabulary, length, per_shard, key)
    shards = max(1, -(-total // per_shard))
    each = -(-shards // WAVES)
    with _shuffles_removed(spark):
        waves = (_ordered(placed, k, min(each, shards - k), length, per_shard) for k in range(0, shards, each))
        paths = [written(_shards(wave, folder, length, per_shard), "slots") for wave in waves]
    slots = spark.read.parquet(*paths)
    _manifest(slots, folder, length, per_shard)
    return slots.drop("__written")


def read_sequences(folder: str, slot: int = 0, digest: str | None = None) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order: what a training run that stopped before that slot reads next.

    digest: that of the manifest with which the run began; an order that is not the same is refused.
    """
    system, root = _filesystem(folder)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    if digest not in (None, manifest["digest"]):
        raise ValueError(f"{folder} holds another order: its digest is {manifest['digest']}, not {digest}")
    stride = 2 * manifest["length"]
    while slot < manifest["sequences"]:
        shard, first = divmod(slot, manifest["per_shard"])
        here = min(manifest["per_shard"], manifest["sequences"] - shard * manifest["per_shard"])
        with system.open_input_file(_shard(root, shard)) as f:
            f.seek(first * stride)
            for _ in range(first, here):
                yield np.frombuffer(f.read(stride), "<u2")
        slot += here - first
