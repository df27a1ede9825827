"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can be divided by."""
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, F.lit(1.0)).otherwise(size)


def unit(v: Column) -> Column:
    """v divided by its length, in doubles; a zero vector stays as it is."""
    # the length is bound once: inside the function of the elements it would be taken for each of them
    return F.transform(F.array(norm(v)), lambda size: F.transform(v, lambda x: x.cast("double") / size))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
