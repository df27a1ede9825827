"""Rows that share a band of their signatures, compared pair by pair in tiles that fit a task.

All rows with one band key form a bucket. A bucket of more than BLOCK rows is cut into blocks of about BLOCK, and each pair of
blocks is a tile of its own, so no bucket, however large, is bound to one task, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket in a block.
BLOCK = 2048
#: Pairs that are looked at together, and of those signatures that are.
AT_ONCE, ROWS = 1 << 18, 1 << 14

Tile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids, tile keys, bands, blocks, signatures


def tiled(sides: DataFrame, bands: int, width: int) -> DataFrame:
    """(tile, block, band, doc_id, signature), by tile: sides has doc_id and signature, of bands times width bytes.

    Rows that share no band with another row are not there. sides is read three times.
    """
    low = (1 << (bands - 1).bit_length()) - 1  # a bucket's number ends in its band
    keys = F.array(*(F.xxhash64(F.substring("signature", 1 + k * width, width)).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(k)) for k in range(bands)))
    rows = sides.select("doc_id", F.explode(keys).alias("key"))
    # counted with partial sums and joined back, so that a large bucket is no task's window; its blocks are hashed
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    narrow = spread.select(F.col("doc_id").alias("__doc"), "block", F.col("key").bitwiseAND(F.lit(low)).cast("int").alias("band"), tile.alias("tile"))
    joined = narrow.join(sides, F.col("__doc") == F.col("doc_id")).select("tile", "block", "band", "doc_id", "signature")
    return joined.repartition("tile").sortWithinPartitions("tile", "block")


def pairs(keys: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row, earlier row) of each tile, some at a time: rows are ordered by keys, then block, and pair up
    with the earlier ones of their key, in a tile of two blocks with those of the first block only."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, keys.size))
    first = np.repeat(new, sizes)
    at = np.arange(keys.size)
    two = block != block[first]  # rows of a second block
    ones = np.repeat(np.add.reduceat((~two).astype(np.int64), new) if new.size else new, sizes)
    crossed = ones < np.repeat(sizes, sizes)
    partners = np.where(crossed, np.where(two, ones, 0), at - first)
    upto = np.cumsum(partners)
    start = 0
    while start < keys.size:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + AT_ONCE, "right")))
        n = partners[start:stop]
        row = np.repeat(at[start:stop], n)
        yield row, np.repeat(first[start:stop], n) + np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def near(tile: Tile, bands: int, similarity: Callable[[np.ndarray], np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, earlier row, similarity) of the pairs of at least least; a pair that shares several bands comes up at the first."""
    ids, keys, band, block, all_ = tile
    parts = all_.reshape(len(all_), bands, -1)
    for hit, with_ in pairs(keys, block):
        for k in range(bands):
            at = band[hit]
            if not (at >= k).any():
                break
            equal = (parts[hit, k] == parts[with_, k]).all(1)
            mine = np.where(at > k, ~equal, (at < k) | equal)
            hit, with_ = hit[mine], with_[mine]
        same = np.zeros(hit.size, np.int32)
        for k in range(0, hit.size, ROWS):
            same[k : k + ROWS] = (all_[hit[k : k + ROWS]] == all_[with_[k : k + ROWS]]).sum(1)
        found = similarity(same)
        ok = (found >= least) & (ids[hit] != ids[with_])
        yield hit[ok], with_[ok], found[ok]


def by_tiles(use: Callable[[Tile], Iterator[pa.RecordBatch]], kind: type, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over tiled(): whole tiles are taken together. Signatures are size numbers of a kind."""

    def taken(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, band, block, ids = (rows.column(c).combine_chunks().to_numpy() for c in ("tile", "band", "block", "doc_id"))
        yield from use((ids, keys, band, block, np.frombuffer(b"".join(rows.column("signature").to_pylist()), kind).reshape(-1, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column("tile").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # where the last tile begins; it may go on
            if last:
                held[-1] = batch.slice(0, last)
                yield from taken(pa.Table.from_batches(held))
                held = [batch.slice(last)]
        if held:
            yield from taken(pa.Table.from_batches(held))

    return run
