"""Ranks and running sums that need no single-task window.

A global or per-source window sends a hot source to one task. Here rows fall into buckets that are
ordered among themselves, a small table holds each bucket's sum, and the window runs within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the order key that name a bucket: 4096 buckets a group.
DIGITS = 3


def seeded_key(seed: int, *parts: Column) -> Column:
    """Order key as 32 hexadecimal digits; a null part counts as the word null."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over the rows of the group that come before, in the order (bucket, order).

    bucket must not decrease along order. Groups must not be null. df is read twice, so cut it first.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__weight", weight.cast("long"))
    sums = rows.groupBy(*group, "__bucket").agg(F.sum("__weight").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, [*group, "__bucket"])
        .withColumn(name, F.col("__before") + F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
        .drop("__bucket", "__weight", "__before")
    )


def ranked(df: DataFrame, group: list[str], key: str, ties: list[str], name: str) -> DataFrame:
    """df with the rank from 0 within the group by a key from seeded_key; ties decide equal keys."""
    return running_sum(df, group, F.substring(F.col(key), 1, DIGITS), [F.col(key), *(F.col(t) for t in ties)], F.lit(1), name)
