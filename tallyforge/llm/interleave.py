"""Proportional stratified interleaving of sources into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import DIGITS, ranked, running_sum, seeded_key
from ..plans.scratch import cut

SHARDS, SEED = 16, 29


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, position, shard): a global order in which every stretch has the corpus's mixture.

    Row r (from 0) of the n rows of its source, in seeded order, has the fractional rank (2 r + 1) / (2 n);
    position counts the rows from 0 by fractional rank, then source; shard is position * shards div rows.
    So no shard's count of a source differs from the source's exact share by 2 or more.

    A null source is a source of its own and comes first. A null doc_id is shuffled as the word null. Rows
    of one doc_id are told apart by source only and otherwise alike. The text is not looked at. No rows: no rows.
    """
    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = cut(docs.select("doc_id", source.alias("__source"), seeded_key(seed, F.col("doc_id")).alias("__key")))
    within = ranked(rows, ["__source"], "__key", ["doc_id"], "__rank").drop("__key")
    sizes = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
    placed = cut(within.join(sizes, "__source").withColumn("__at", (2 * F.col("__rank") + 1).cast("double") / (2 * F.col("__n")).cast("double")))
    total = placed.count()
    bucket = F.floor(F.col("__at") * 16**DIGITS)
    return running_sum(placed.withColumn("__all", F.lit(0)), ["__all"], bucket, [F.col("__at"), F.col("__source")], F.lit(1), "position").select(
        "doc_id", F.when(F.col("__source") != "", F.substring("__source", 2, 1 << 20)).alias("source"), "position", F.floor(F.col("position") * shards / F.lit(max(total, 1))).cast("int").alias("shard")
    )
