"""BagMinHash signatures: near copies by weighted Jaccard similarity of bags of word pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.scratch import cut
from . import buckets
from .words import Step, grams, mixed, steps

#: Components of a signature, in BANDS bands; the least similarity of a near copy.
SIZE, BANDS, LEAST = 160, 40, 0.5
#: How far an estimate from two signatures may lie under the similarity (5 standard deviations).
SLACK = 0.2

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(step: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times), ordered by text and feature: how often each pair of neighbouring words occurs.

    A text of one word has that word as its feature. Features have 48 bits.
    """
    words = step.hashes(step.starts, step.ends)
    keys, at = grams(words, step.doc, 2)
    doc = step.doc[at]
    alone = np.flatnonzero(np.bincount(step.doc, minlength=step.n)[step.doc] == 1)
    packed = np.concatenate([doc, step.doc[alone]]).astype(np.uint64) << np.uint64(48)
    packed |= np.concatenate([keys, words[alone]]) >> np.uint64(16)
    packed.sort()
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if packed.size else np.zeros(0, np.int64)
    return (packed[new] >> np.uint64(48)).astype(np.int64), packed[new] & np.uint64((1 << 48) - 1), np.diff(np.append(new, packed.size))


def signatures(doc: np.ndarray, feature: np.ndarray, times: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """n x size numbers of 32 bits; two texts agree in a component with the chance of their bags' weighted Jaccard.

    A feature owns a marked Poisson process over (time, weight, component), a function of the feature alone:
    weights are discretised to whole numbers, and the axis of weights is split into (0, 1], (1, 2], (2, 4],
    (4, 8] and so on, each with a process whose rate is its length; in an interval that a bag's weight covers
    partly, a point is split down to its unit and counts if that lies under the weight. A component takes the
    earliest point of all the bag's features. Points are made in order of time, and a process stops when it
    is past the text's latest component, so few are made however large the weights.
    """
    first = np.full(n * size, np.inf)
    level = np.where(times > 1, np.ceil(np.log2(times)), 0).astype(np.int64)
    row = np.repeat(np.arange(doc.size), level + 1)
    block = np.arange(row.size) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    doc, weight = doc[row], times[row]
    under = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    rate = np.maximum(under, 1).astype(float)
    state = mixed(feature[row] * np.uint64(0xD1342543DE82EF95) + block.astype(np.uint64))
    time = np.zeros(row.size)
    while time.size:
        state = mixed(state + _GOLDEN)
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        mark = mixed(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        component = (((mark >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        unit = under + 1 + (((mark & np.uint64(0xFFFFFFFF)) * rate.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = unit <= np.maximum(weight, 1)
        np.minimum.at(first, doc[counts] * size + component[counts], time[counts])
        latest = first.reshape(n, size).max(1)
        live = time < latest[doc]
        doc, weight, under, rate, state, time = doc[live], weight[live], under[live], rate[live], state[live], time[live]
    return (mixed(first.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n, size)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (features in order, times); of two empty ones 1."""
    total = int(a[1].sum() + b[1].sum())
    if a[0].size > b[0].size:
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == b[0].size] = 0
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()) if b[0].size else 0
    return both / (total - both) if total else 1.0


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch.column("text")):
            doc, feature, times = bags(step)
            ids = batch.column("doc_id").slice(step.first, step.n)
            # an order-free hash of the whole bag, in two halves
            each = mixed(feature * _GOLDEN + times.astype(np.uint64))
            one, two = np.zeros(step.n, np.uint64), np.zeros(step.n, np.uint64)
            np.add.at(one, doc, each)
            np.add.at(two, doc, mixed(each ^ np.uint64(0x5851F42D4C957F2D)))
            some = np.bincount(doc, minlength=step.n) > 0
            halves = (signatures(doc, feature, times, step.n) >> np.uint32(16)).astype(np.uint16)
            raw = pa.array([halves[i].tobytes() if there else None for i, there in enumerate(some)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), raw], ["doc_id", "one", "two", "signature"])


def _linked(least: float):
    def run(tile: buckets.Tile) -> Iterator[pa.RecordBatch]:
        """Of each part of the pairs, no more edges than connect what its pairs connect."""
        ids = tile[0]
        for hit, with_, _ in buckets.near(tile, BANDS, lambda same: same / SIZE, least - SLACK):
            root, before = np.arange(ids.size), None
            while before is None or (root != before).any():
                before = root.copy()
                np.minimum.at(root, hit, root[with_])
                np.minimum.at(root, with_, root[hit])
                root = root[root]
            at = np.flatnonzero(root != np.arange(ids.size))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[at]]), pa.array(ids[at])], ["a", "b"])

    return buckets.by_tiles(run, np.uint16, SIZE)


class _Greedy:
    """In order of doc_id, a text joins the most similar text that stays, or stays itself."""

    def __init__(self, least: float):
        self.least, self.component = least, None

    def place(self, component: int, doc_id: int, bag: tuple[np.ndarray, np.ndarray], signature: np.ndarray) -> tuple[int, float]:
        if component != self.component:
            self.component, self.ids, self.bags, self.n = component, [], [], 0
            self.signatures = np.zeros((4, signature.size), np.uint32)
        near = np.flatnonzero((self.signatures[: self.n] == signature).mean(1) >= self.least - SLACK) if self.n else []
        found = max(((overlap(bag, self.bags[i]), -i) for i in near), default=(0.0, 0))
        if found[0] >= self.least:
            return self.ids[-found[1]], found[0]
        if self.n == len(self.signatures):
            self.signatures = np.concatenate([self.signatures, np.zeros_like(self.signatures)])
        self.signatures[self.n] = signature
        self.ids.append(doc_id)
        self.bags.append(bag)
        self.n += 1
        return doc_id, 1.0


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = _Greedy(least)
        for batch in batches:
            ids, components = batch.column("doc_id").to_pylist(), batch.column("component").to_pylist()
            out: list[tuple[int, float]] = []
            for step in steps(batch.column("text")):
                doc, feature, times = bags(step)
                found = signatures(doc, feature, times, step.n)
                cuts = np.searchsorted(doc, np.arange(step.n + 1))
                for i in range(step.n):
                    part = slice(cuts[i], cuts[i + 1])
                    out.append(greedy.place(components[step.first + i], ids[step.first + i], (feature[part].copy(), times[part].copy()), found[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], ["__rep", "group_id", "similarity"])

    return run


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, group_id, similarity, keep): one row for each doc_id; group_id names the document that stays.

    A document's bag holds each pair of neighbouring words as often as it occurs. Documents that share a
    band of their BagMinHash signatures, and whose signatures agree in nearly least of their components (SLACK
    less), are candidates; what candidates connect is brought together once, with the texts, and read in order of doc_id: a document with an overlap (weighted Jaccard) of at least
    least with one that stays goes to the most similar of those, the lower doc_id first, else it stays. So every
    document that goes has a verified near copy that stays, and no two that stay and were candidates are near copies.
    similarity is the overlap with group_id, 1 for a document that stays. Equal bags share one fate: all but the lowest doc_id go.

    Texts without words (null and empty ones too) have equal, empty bags. Rows of equal doc_id count as one
    document, that with the lowest hash of its text. Rows with a null doc_id can't be named: they have no row. No
    documents: no rows. Other columns are not looked at.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = cut(texts.mapInArrow(_keyed, "doc_id long, one long, two long, signature binary"))
    named = keyed.groupBy("doc_id").agg(F.min(F.struct("one", "two")).alias("bag")).select("doc_id", "bag.*")
    classes = cut(named.join(named.groupBy("one", "two").agg(F.min("doc_id").alias("__rep")), ["one", "two"]).select("doc_id", "one", "two", "__rep"))
    reps = classes.where("doc_id = __rep").select(F.col("doc_id").alias("__rep"), "one", "two")
    alike = keyed.where("signature is not null").join(reps, (F.col("doc_id") == F.col("__rep")) & (keyed["one"] == reps["one"]) & (keyed["two"] == reps["two"]), "left_semi")
    alike = alike.select("doc_id", "one", "two", "signature").distinct().select("doc_id", "signature")
    edges = buckets.tiled(alike, BANDS, 2 * SIZE // BANDS).mapInArrow(_linked(least), "a long, b long")
    components = connected_components(cut(edges))
    gathered = (
        texts.join(components, texts["doc_id"] == components["node"])
        .select("doc_id", "text", "component")
        .repartition("component")
        .sortWithinPartitions("component", "doc_id", F.xxhash64("text"))
    )
    bare = gathered.mapInArrow(_verified(least), "__rep long, group_id long, similarity double")
    verified = bare.groupBy("__rep").agg(F.max_by(F.struct("group_id", "similarity"), F.struct("similarity", -F.col("group_id"))).alias("found")).select("__rep", "found.*")
    return classes.join(verified, "__rep", "left").select(
        "doc_id", F.coalesce("group_id", "__rep").alias("group_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"), (F.col("doc_id") == F.coalesce("group_id", "__rep")).alias("keep")
    )


def without_near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the documents that go, with all columns; of rows of equal doc_id one stays, null ones all."""
    columns = docs.columns
    packed = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*(docs[c] for c in columns)).alias("__all"))
    # rows of one doc_id are brought to one by partial minima, with the shuffle that the join needs anyway
    one = packed.where("__id is not null").groupBy("__id").agg(F.min_by("__all", F.struct(F.xxhash64(F.col("__all")["text"]), F.xxhash64("__all"))).alias("__all"))
    stays = near_duplicates(docs, least).where("keep").select(F.col("doc_id").alias("__stays"))
    kept = one.join(stays, F.col("__id") == F.col("__stays"), "left_semi").select("__all").union(packed.where("__id is null").select("__all"))
    return kept.select(*(F.col("__all")[c].alias(c) for c in columns))
