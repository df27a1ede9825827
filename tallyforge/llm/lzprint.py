"""Lempel-Ziv phrase fingerprints, compared by minimum hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.scratch import cut, written
from . import buckets
from .words import Step, mixed, steps

#: Minimum hashes of a signature, in BANDS bands; the least share of equal ones for a match.
SIZE, BANDS, LEAST = 160, 32, 0.6
_A = mixed(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(SIZE + 1, 2 * SIZE + 1, dtype=np.uint64))


def phrases(words: list[int]) -> list[int]:
    """Keys of the phrases of an LZ78 parse: each is the longest phrase known so far and one word more.

    A last phrase that is known already adds nothing.
    """
    known: set[int] = set()
    add = known.add
    at = 0
    for word in words:
        at = (at * 0x2545F4914F6CDD1D + word) & 0xFFFFFFFFFFFFFFFF
        if at not in known:
            add(at)
            at = 0
    return list(known)


def parsed(step: Step) -> tuple[list[list[int]], np.ndarray]:
    """The phrases of each text of the step, and the minimum hashes."""
    words = step.hashes(step.starts, step.ends).tolist()
    cuts = np.searchsorted(step.doc, np.arange(step.n + 1))
    found = [phrases(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    out = np.full((step.n, SIZE), np.iinfo(np.uint64).max, np.uint64)
    for i, keys in enumerate(found):
        base = mixed(np.array(keys, np.uint64))
        for k in range(0, base.size, 4096):
            np.minimum(out[i], (base[k : k + 4096, None] * _A + _B).min(0), out=out[i])
    return found, out


def signatures(found: np.ndarray) -> np.ndarray:
    """A byte of each minimum hash: two that differ have equal bytes with a chance of 1 / 256."""
    return (mixed(found) >> np.uint64(56)).astype(np.uint8)


def similarity(same: np.ndarray) -> np.ndarray:
    """The share of equal minimum hashes, from the number of equal bytes."""
    return np.maximum(0.0, (same / SIZE - 1 / 256) / (1 - 1 / 256))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_phrases", "print_a", "print_b", "signature"]
    for batch in batches:
        for step in steps(batch.column("text")):
            known, found = parsed(step)
            halves = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.full(step.n, salt, np.uint64)
                for k in range(SIZE):
                    total = mixed(total * np.uint64(salt) + found[:, k])
                halves.append(pa.array(total.view(np.int64)))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIZE), step.n, [None, pa.py_buffer(signatures(found).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(step.first, step.n), pa.array([len(k) for k in known], pa.int32()), *halves, raw], names)


def _compared(tile: buckets.Tile) -> Iterator[pa.RecordBatch]:
    ids = tile[0]
    for hit, with_, share in buckets.near(tile, BANDS, similarity, LEAST):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[hit], ids[with_])), pa.array(np.maximum(ids[hit], ids[with_])), pa.array(share)], ["doc_a", "doc_b", "similarity"])


def _counted(tile: buckets.Tile) -> Iterator[pa.RecordBatch]:
    """Of each row with a match, how many it has, and the first row that matches lead it to: no more rows than tile has."""
    ids = tile[0]
    links, root = np.zeros(ids.size, np.int64), np.arange(ids.size)
    for hit, with_, _ in buckets.near(tile, BANDS, similarity, LEAST):
        links += np.bincount(hit, minlength=ids.size) + np.bincount(with_, minlength=ids.size)
        while ((one := root[hit]) != (two := root[with_])).any():
            np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
            while (root != (up := root[root])).any():
                root = up
    at = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at])], ["a", "b", "links"])


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its print and rep_id; (__rep, __a, __b), the prints that have words and a rep_id; and those with their signatures."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = written(texts.mapInArrow(_printed, "doc_id long, n_phrases int, print_a long, print_b long, signature binary"), "lzprint")
    prints = spark.read.parquet(path)
    narrow = prints.select("doc_id", "n_phrases", "print_a", "print_b")
    lowest = narrow.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep_id"))
    classes = cut(narrow.join(lowest, ["print_a", "print_b"]))
    reps = classes.where("doc_id = rep_id and n_phrases > 0").select(F.col("rep_id").alias("__rep"), F.col("print_a").alias("__a"), F.col("print_b").alias("__b")).distinct()
    sides = prints.join(reps, (prints["doc_id"] == F.col("__rep")) & (prints["print_a"] == F.col("__a")) & (prints["print_b"] == F.col("__b")), "left_semi")
    return classes, reps, sides.select("doc_id", "print_a", "print_b", "signature").distinct()  # by the join's keys, without a shuffle of its own


def _name():
    return F.lower(F.concat(F.lpad(F.hex("print_a"), 16, "0"), F.lpad(F.hex("print_b"), 16, "0"))).alias("fingerprint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, fingerprint, rep_id, similar, similarities): one row for each row of docs.

    The words of a text are parsed into LZ78 phrases; fingerprint names, in 32 hexadecimal digits, the SIZE
    minimum hashes of the set of phrases. rep_id is the lowest doc_id of equal fingerprint. similar lists, in
    order, the rep_ids, other than the row's own, of all fingerprints with at least LEAST of their minimum hashes
    equal to the row's that share one of BANDS bands with it; similarities lists those shares. Each pair is
    compared where it first shares a band, and large buckets are spread over tasks, so a pair costs what it costs
    in brute force and no group of copies is bound to one task. The lists grow with the square of a group of near
    copies, and each copy repeats its class's: linked() is for large tables.

    Texts without words (null and empty ones too) have no phrase; their fingerprints are equal and match no
    other. Rows of a null doc_id get a fingerprint; rep_id is then null unless another row has that
    fingerprint, and they are not looked for on behalf of others. Rows of equal doc_id get a row each;
    what its different texts match is listed together. No documents: no rows. Other columns are not looked at.
    """
    classes, _, sides = _classified(docs)
    sides = sides.select("doc_id", "signature")
    gathered = buckets.tiled(sides, BANDS, SIZE // BANDS)
    pairs = gathered.mapInArrow(buckets.by_tiles(_compared, np.uint8, SIZE), "doc_a long, doc_b long, similarity double")
    sided = pairs.select(F.col("doc_a").alias("__rep"), F.struct(F.col("doc_b").alias("id"), "similarity").alias("m")).union(pairs.select(F.col("doc_b").alias("__rep"), F.struct(F.col("doc_a").alias("id"), "similarity").alias("m")))
    lists = sided.groupBy("__rep").agg(F.array_sort(F.array_distinct(F.collect_list("m"))).alias("m"))
    return classes.join(lists, classes["rep_id"] == lists["__rep"], "left").select(
        "doc_id", "n_phrases", _name(), "rep_id",
        F.coalesce(F.col("m.id"), F.array().cast("array<long>")).alias("similar"), F.coalesce(F.col("m.similarity"), F.array().cast("array<double>")).alias("similarities"),
    )


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, fingerprint, rep_id, class_id, links): one row for each row of docs.

    The first four columns, and the pairs that match, are those of fingerprints(). links is the number of other fingerprints that
    match the row's: copies (equal rep_id) are one. class_id is the lowest doc_id that the row's copies and matches, theirs, and so on
    lead to. Pairs are counted where they are compared and never listed, so a step gives no more rows than it takes.

    Texts without words have no link, and rows of a null doc_id are not looked for, as in fingerprints(). Of rows of equal doc_id
    each has the links of its own text. Fingerprints are told apart by their first 64 bits here. No documents: no rows.
    """
    classes, reps, sides = _classified(docs)
    gathered = buckets.tiled(sides.select(F.col("print_a").alias("doc_id"), "signature"), BANDS, SIZE // BANDS)
    # by row and the row it leads to, so that what is kept between steps has a row for few tiles of each
    counted = gathered.mapInArrow(buckets.by_tiles(_counted, np.uint8, SIZE), "a long, b long, links long")
    counted = cut(counted.groupBy("a", "b").agg(F.sum("links").alias("links")))
    links = counted.groupBy("a").agg(F.sum("links").alias("links"))
    ids = connected_components(counted).join(reps.select("__a", "__rep"), F.col("node") == F.col("__a"))
    known = ids.join(ids.groupBy("component").agg(F.min("__rep").alias("class_id")), "component").select("node", "class_id")
    known = known.distinct().join(links, F.col("node") == F.col("a")).select("node", "class_id", "links")
    return classes.join(known, (classes["print_a"] == known["node"]) & F.col("rep_id").isNotNull(), "left").select(
        "doc_id", "n_phrases", _name(), "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )
