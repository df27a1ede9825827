"""Statistics of pairwise cosines, within groups and against all other rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tau_key
from ..functions.vectors import unit
from ..plans.scratch import cut
from .blocks import TILE, matrix, paired

#: Rows of a block of a small table.
BLOCK = 1024
_SUMS = "n long, total double, squares double, low double, high double"


def _folded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def _spread(prefix: str) -> list:
    """Mean, population standard deviation, least and most, from folded sums; null without a pair."""
    mean = F.col("total") / F.col("n")
    some = F.col("n") > 0
    return [
        F.when(some, mean).alias(f"{prefix}_mean"),
        F.when(some, F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))).alias(f"{prefix}_std"),
        F.col("low").alias(f"{prefix}_min"),
        F.col("high").alias(f"{prefix}_max"),
    ]


def _runs(names: np.ndarray) -> list[np.ndarray]:
    """Cuts of sorted rows into tiles of at most TILE; a new group begins a tile once the one before has a quarter of that."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    cuts, last = [], 0
    for end in [*starts[1:].tolist(), len(names)]:
        while end - last > TILE:
            cuts.append(last)
            last += TILE
        if end - last >= TILE // 4 or end == len(names):
            cuts.append(last)
            last = end
    return [np.arange(x, y) for x, y in zip(cuts, [*cuts[1:], len(names)]) if x < y]


def _products(vectors: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(kind, g, n, total, squares, low, high): sums over blocks of pairs, kind within or others, g the group as a number."""
    grouped = vectors.where("embedding is not null").select(F.lit(0).alias("g"), F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)).alias("name"), unit(F.col("embedding")).alias("v"), F.xxhash64("embedding", "id").alias("id"))

    def sums(table):
        import pyarrow as pa

        v, of = matrix(table["v"]), table["i"].to_numpy()
        names, group = np.unique(table["name"].to_numpy().astype(str), return_inverse=True)
        ends = [table[k][0].as_py() for k in ("lo", "hi")]
        one = ends[0] == ends[1]
        sides = []
        for k in ends[: 1 if one else 2]:
            at = np.flatnonzero(of == k)
            at = at[np.argsort(group[at], kind="stable")]
            sides.append([(v[at[t]], group[at[t]]) for t in _runs(group[at])])
        # by kind (within, others) and group
        n, total, squares = np.zeros((2, len(names)), np.int64), np.zeros((2, len(names))), np.zeros((2, len(names)))
        low, high = np.full((2, len(names)), np.inf), np.full((2, len(names)), -np.inf)
        room = np.empty(TILE * TILE)  # taking new memory for each tile costs more than the products
        for x, (left, gx) in enumerate(sides[0]):
            for y, (right, gy) in enumerate(sides[-1]):
                if one and y < x:
                    continue
                values = np.matmul(left, right.T, out=room[: len(left) * len(right)].reshape(len(left), len(right)))
                diagonal = one and x == y
                # rows and columns are in order of their groups, so a pair of groups is a rectangle
                at = [np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) for c in (gx, gy)]
                size = [np.diff(np.append(first, len(c))) for first, c in zip(at, (gx, gy))]
                a, b = gx[at[0]], gy[at[1]]

                def folded(ufunc, matrix_: np.ndarray, itself: float) -> np.ndarray:
                    if diagonal:
                        np.fill_diagonal(matrix_, itself)
                    if matrix_.size and len(a) == len(b) == 1:
                        return ufunc.reduce(matrix_, axis=None).reshape(1, 1)
                    return ufunc.reduceat(ufunc.reduceat(matrix_, at[1], axis=1), at[0], axis=0)

                least, most = folded(np.minimum, values, np.inf), folded(np.maximum, values, -np.inf)
                added = folded(np.add, values, 0.0)
                squared = np.vdot(values, values).reshape(1, 1) if len(a) == len(b) == 1 else folded(np.add, np.square(values, out=values), 0.0)
                number = np.outer(*size).astype(np.int64)
                same = a[:, None] == b[None, :]
                for kind, here in ((0, same), (1, ~same)):
                    i, j = np.nonzero(here)
                    # within a diagonal tile each pair is there twice, and each row with itself; pairs of two groups count for each of them
                    for groups in (a[i],) if kind == 0 or diagonal else (a[i], b[j]):
                        twice = 2 if diagonal and kind == 0 else 1
                        np.add.at(n[kind], groups, (number[i, j] - size[0][i]) // 2 if twice == 2 else number[i, j])
                        np.add.at(total[kind], groups, added[i, j] / twice)
                        np.add.at(squares[kind], groups, squared[i, j] / twice)
                        np.minimum.at(low[kind], groups, least[i, j])
                        np.maximum.at(high[kind], groups, most[i, j])
        kind, at = np.nonzero(n)
        found = {"kind": np.array(["within", "others"], object)[kind], "g": names[at].astype(object), **{c: x[kind, at] for c, x in (("n", n), ("total", total), ("squares", squares), ("low", low), ("high", high))}}
        return pa.table({c: pa.array(x, pa.string()) if x.dtype == object else pa.array(x) for c, x in found.items()})

    return paired(grouped, block).groupBy("g", "lo", "hi").applyInArrow(sums, f"kind string, g string, {_SUMS}")


def overall(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(num_vectors, mean, std, min, max) over all pairs of rows; the last four null for fewer than two rows."""
    one = vectors.withColumn("__all", F.lit(1))
    folded = _folded(_products(one, ["__all"], block).where("kind = 'within'"), []).select(*_spread("all"))
    number = vectors.where("embedding is not null").agg(F.count(F.lit(1)).alias("num_vectors"))
    return number.crossJoin(folded).select("num_vectors", F.col("all_mean").alias("mean"), F.col("all_std").alias("std"), F.col("all_min").alias("min"), F.col("all_max").alias("max"))


def by_group(vectors: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, count, within_mean .. within_max, vs_others_mean .. vs_others_max): one row a group.

    within is over the pairs of the group, null for a single row; vs_others over a row of the group and one of any other, null where
    there is no other. Blocks of rows are multiplied pair by pair, and only sums leave a task. vectors has id, embedding and the keys.
    """
    sums = cut(_folded(_products(vectors, keys, block), ["kind", "g"]))  # both kinds are read from it: else all products are made twice
    within = sums.where("kind = 'within'").select("g", *_spread("within"))
    others = sums.where("kind = 'others'").select("g", *_spread("vs_others"))
    counts = vectors.where("embedding is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("g", F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)))
    return counts.join(within, "g", "left").join(others, "g", "left").drop("g")


def over_thresholds(frames: dict[float, DataFrame], keys: list[str]) -> DataFrame:
    """One wide row per key: each frame's other columns with the suffix _tau_<threshold>, joined on the keys (full outer)."""
    out = None
    for tau, frame in frames.items():
        suffix = "_tau_" + ("%.6f" % tau).rstrip("0").rstrip(".")
        renamed = frame.select(*keys, *(F.col(c).alias(c + suffix) for c in frame.columns if c not in keys))
        out = renamed if out is None else out.join(renamed, keys, "outer")
    return out


def active(flags: DataFrame, tau: float, include_dropped: bool = False) -> DataFrame:
    """ids that are not dropped at the threshold; a missing flag is no drop. flags has id, tau (as tau_key gives it) and dropped."""
    at = flags.where(F.col("tau") == tau_key(F.lit(tau)))
    return at.where(F.lit(include_dropped) | ~F.coalesce("dropped", F.lit(False))).select("id")


def plane(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """(id, x, y): the two principal components of the unit vectors, each signed so that its largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where("embedding is not null").select("id", array_to_vector(unit(F.col("embedding"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    at = vector_to_array("p")
    return model.transform(rows).select("id", (at[0] * signs[0]).alias("x"), (at[1] * signs[1]).alias("y"))
