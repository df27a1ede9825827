"""Rows for Python functions that are long work on few bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in four partitions a core. A small file is read by one task or a few, which is no measure of what a parser does with its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
