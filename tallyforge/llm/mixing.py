"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import word_count
from ..plans.ranking import ranked, running_sum, seeded_key
from ..plans.scratch import cut

#: Tokens of a block; shards; blocks of the mixture, as a share of the blocks that all sources hold; how often a source may be
#: gone through, as a short one is to reach its target weight.
BLOCK_TOKENS, SHARDS, KEEP, EPOCHS, SEED = 1024, 8, 0.8, 4, 17


def apportion(weights: list[int], caps: list[int], house: int) -> list[int]:
    """Seats of each source: the house highest quotients weight / (2 k - 1), k from 1 to the source's cap.

    Equal quotients go to the source that is listed first. Sources of no weight get nothing; with fewer
    seats to give than house, all sources with a weight are filled.
    """
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps)]
    if sum(caps) <= house:
        return caps

    def at_least(q: float) -> list[int]:
        return [min(c, int((w / q + 1) // 2)) if w > 0 else 0 for w, c in zip(weights, caps)]

    low, high = min(w / (2 * c + 1) for w, c in zip(weights, caps) if c), 2.0 * max(weights)
    for _ in range(100):  # high: too few seats or just enough
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if sum(at_least(middle)) > house else (low, middle)
    # a step back, so that rounding at the bound can give no seat too many; the heap gives the rest exactly
    seats = at_least(high * (1 + 1e-9))
    rest = [(-(w / (2 * s + 1)), i) for i, (w, s, c) in enumerate(zip(weights, seats, caps)) if s < c]
    heapq.heapify(rest)
    for _ in range(house - sum(seats)):
        _, i = heapq.heappop(rest)
        seats[i] += 1
        if seats[i] < caps[i]:
            heapq.heappush(rest, (-(weights[i] / (2 * seats[i] + 1)), i))
    return seats


def placed(docs: DataFrame, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(doc_id, __source, tokens, start): each document's place in its source's seeded token stream.

    A null source is a source of its own. Documents without tokens stay, with tokens 0.
    """
    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = cut(docs.select("doc_id", source.alias("__source"), (word_count(F.col("text")) if tokens is None else tokens).alias("tokens"), seeded_key(seed, F.col("doc_id")).alias("__key")))
    return running_sum(rows, ["__source"], F.substring("__key", 1, 3), [F.col("__key"), F.col("doc_id"), F.col("tokens")], F.col("tokens"), "start").drop("__key")


def mixed_blocks(
    streams: DataFrame, weights: DataFrame | None = None, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, keep: float = KEEP, epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """(__source, __tokens, block, shard, slot): the blocks that the apportionment and the seeded selection take.

    streams: what placed() gives. weights: (source, weight) with integer weights, a source that is not
    listed has none; by default the square root of the source's tokens, in thousandths.
    """
    sizes = streams.groupBy("__source").agg(F.sum("tokens").alias("__tokens"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.floor(F.sqrt(F.col("__tokens").cast("double")) * 1000).cast("long"))
    else:
        named = weights.select(F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("__source"), F.col("weight").cast("long").alias("__w"))
        sizes = sizes.join(named, "__source", "left").fillna(0, ["__w"])

    def seats(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__source")
        tokens = [int(t) for t in rows["__tokens"]]
        supply = [-(-t // block_tokens) for t in tokens]
        quotas = apportion([int(w) for w in rows["__w"]], [-(-epochs * t // block_tokens) for t in tokens], math.ceil(keep * sum(supply)))
        before = [0, *accumulate(quotas)][:-1]
        return pd.DataFrame({"__source": rows["__source"], "__tokens": tokens, "__supply": supply, "__quota": quotas, "__first": [n % shards for n in before]})

    # one row a source: the only step that sees all of them at once
    quotas = sizes.groupBy(F.lit(1).alias("__all")).applyInPandas(seats, "__source string, __tokens long, __supply long, __quota long, __first long").where("__quota > 0")
    rounds = F.ceil(F.col("__quota") / F.col("__supply")) * F.col("__supply")
    blocks = quotas.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
    blocks = blocks.withColumn("__lap", F.floor(F.col("block") / F.col("__supply"))).withColumn("__key", seeded_key(seed, F.substring("__source", 2, 1 << 20), F.col("block")))
    drawn = ranked(cut(blocks), ["__source", "__lap"], "__key", ["block"], "__within").withColumn("__rank", F.col("__lap") * F.col("__supply") + F.col("__within"))
    dealt = F.col("__first") + F.col("__rank")
    return drawn.where(F.col("__rank") < F.col("__quota")).select("__source", "__tokens", "block", (dealt % shards).cast("int").alias("shard"), F.floor(F.col("__rank") / shards).cast("long").alias("slot"))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, keep: float = KEEP, epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """(source, block, shard, slot, doc_id, token_from, token_to): the mixture, as slices of documents.

    A source's documents, in seeded order, are one stream of tokens that begins again when it ends and is cut every block_tokens,
    so all blocks hold equally many; a document may lie in several. The mixture has keep as many blocks as all sources hold
    (partial ones included), apportioned to the sources: block k of a source goes to the highest quotients weight / (2 k - 1). A source can give
    epochs times its tokens, so that a short one still reaches its share; no source with tokens is too small. Which blocks of a source those are,
    a seeded order decides, within each round through the stream. They are dealt to the shards in turn, one source after the
    other: a shard's quota of a source is the number of its blocks divided by shards, rounded up or down, and shards have equally many blocks, but for one.
    slot counts a source's blocks in a shard.

    Null and empty texts have no tokens and are in no block. A null source is a source of its own. Equal
    doc_ids follow each other in the stream. No documents: no rows. Other columns are not looked at.
    """
    streams = cut(placed(docs, tokens, block_tokens, seed))
    blocks = mixed_blocks(streams, weights, block_tokens, shards, keep, epochs, seed)
    # the stretches of the stream that a block covers, one for each round, and the cells of block_tokens that they touch
    begin = F.col("block") * block_tokens
    laps = F.sequence(F.floor(begin / F.col("__tokens")), F.floor((begin + block_tokens - 1) / F.col("__tokens")))
    pieces = blocks.withColumn("__lap", F.explode(laps)).withColumn("__from", F.greatest(begin - F.col("__lap") * F.col("__tokens"), F.lit(0)))
    pieces = pieces.withColumn("__to", F.least(begin + block_tokens - F.col("__lap") * F.col("__tokens"), F.col("__tokens")))

    def cells(first: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(first) / block_tokens), F.floor((F.col(end) - 1) / block_tokens)))

    pieces = pieces.select("__source", "block", "shard", "slot", "__from", "__to", cells("__from", "__to").alias("__cell"))
    ends = streams.where("tokens > 0").withColumn("__end", F.col("start") + F.col("tokens"))
    slices = ends.select("__source", "doc_id", "start", "__end", cells("start", "__end").alias("__cell")).join(pieces, ["__source", "__cell"])
    first, last = F.greatest("start", "__from"), F.least("__end", "__to")
    # a document and a stretch meet in several cells: the first counts
    return slices.where((first < last) & (F.col("__cell") == F.floor(first / block_tokens))).select(
        F.when(F.col("__source") != "", F.substring("__source", 2, 1 << 20)).alias("source"), "block", "shard", "slot", "doc_id",
        (first - F.col("start")).alias("token_from"), (last - F.col("start")).alias("token_to"),
    )


def in_mixture(docs: DataFrame, **how) -> DataFrame:
    """docs whose first token lies in a block of the mixture, whole and with all their columns.

    Documents without tokens go. Documents of one doc_id go together: any of them in the mixture keeps all.
    """
    taken = mix(docs, **how).where("token_from = 0").select(F.col("doc_id").alias("__taken")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["__taken"]), "left_semi")
