"""All pairs of the rows of a group, as pairs of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of a group: so many places a row is sent to, however many rows there are.
BLOCKS = 16
#: Most rows of a block (a task has two: 64 MB of vectors of 64); larger groups have more than BLOCKS.
MOST_ROWS = 1 << 16
#: Side of a tile: the products that are in memory at once.
TILE = 1024


def paired(rows: DataFrame, block: int) -> DataFrame:
    """rows, which have id and a group g, once for each pair (lo, hi) of blocks that their block i is in; for groupBy("g", "lo", "hi").

    A group of fewer than BLOCKS * block rows has blocks of about block rows. Rows with a null group have no pairs.
    """
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.select("g", F.greatest(F.ceil(F.col("c") / MOST_ROWS), F.least(F.ceil(F.col("c") / block), F.lit(BLOCKS))).cast("int").alias("n"))
    placed = rows.join(sizes, "g").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    sent = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).drop("n", "j")
    # a number of partitions, as few bytes make many products: by bytes they would be joined into few tasks
    return sent.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "lo", "hi")


def matrix(vectors) -> np.ndarray:
    """An Arrow column of lists of one length as rows of doubles."""
    lists = vectors.combine_chunks() if hasattr(vectors, "combine_chunks") else vectors
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("the vectors have different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lengths), int(lengths[0]) if len(lengths) else 0)


def tiles(rows: int, columns: int, triangle: bool, side: int = TILE) -> Iterator[tuple[slice, slice]]:
    """Slices of rows and of columns; triangle: only those on or above the diagonal."""
    for x in range(0, rows, side):
        for y in range(x if triangle else 0, columns, side):
            yield slice(x, min(x + side, rows)), slice(y, min(y + side, columns))
