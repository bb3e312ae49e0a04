"""Matching records of two tables by nearest time within an entity.

Both tables are cut into ranges of time per entity, each range with margins that overlap its neighbours, and co-grouped
by (entity, range). Within a range a binary search of all positions at once finds the neighbours on both sides. A pair
lies within the tolerance, so a margin of one tolerance on the right table and of two on the left is enough to see,
inside one range, both rows of a pair and every row that could be nearer to either; results do not depend on the ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(positions: np.ndarray, sorted_other: np.ndarray) -> np.ndarray:
    """Index of the nearest of ``sorted_other`` for each position; at equal distance the smaller. -1 if there is none."""
    n = len(sorted_other)
    if n == 0:
        return np.full(len(positions), -1)
    right = np.searchsorted(sorted_other, positions, side="left")
    left = np.clip(right - 1, 0, n - 1)
    left = np.searchsorted(sorted_other, sorted_other[left], side="left")  # the first of equal positions
    right = np.clip(right, 0, n - 1)
    nearer_right = np.abs(sorted_other[right] - positions) < np.abs(positions - sorted_other[left])
    return np.where(nearer_right, right, left)


def _spread(df: DataFrame, margin: Column) -> DataFrame:
    """Each row in its own range and in every range whose margin it lies in."""
    low, high = F.floor((F.col("pos") - margin) / F.col("width")), F.floor((F.col("pos") + margin) / F.col("width"))
    return df.withColumn("range", F.explode(F.sequence(low, high)))


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    position: str,
    key: str,
    tolerance: Column,
    width: Column,
    mutual: bool = True,
) -> DataFrame:
    """Pairs (``entity``, ``left_key``, ``right_key``, ``distance``).

    A left row is paired with the nearest right row of its entity, at equal distance the one of smaller position, among
    rows at one position the one of smaller key, if it is at most ``tolerance`` away. With ``mutual`` the left row must be
    the right row's nearest too. ``tolerance`` and ``width`` (of a range) are expressions over columns that both tables
    carry, in units of ``position``, alike for all rows of an entity; ``width`` must not be less than 1. Rows with a null
    entity, position or tolerance pair with nothing; rows equal in entity, position and key count once. ``key`` is
    integral.
    """

    def prepared(df: DataFrame, reach: int) -> DataFrame:
        rows = df.select(
            F.col(entity).cast("string").alias("entity"), F.col(position).cast("bigint").alias("pos"), F.col(key).cast("bigint").alias("id"),
            F.floor(tolerance).cast("bigint").alias("tol"), F.ceil(width).cast("bigint").alias("width"),
        )
        rows = rows.dropna().filter("tol >= 0 and width >= 1").distinct()
        return _spread(rows, reach * F.col("tol"))

    def join(key_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"entity": pa.array([], pa.string()), "left_key": pa.array([], pa.int64()), "right_key": pa.array([], pa.int64()), "distance": pa.array([], pa.int64())})
        if not len(a) or not len(b):
            return empty
        a, b = (t.sort_by([("pos", "ascending"), ("id", "ascending")]) for t in (a, b))
        ap, bp = a["pos"].to_numpy(), b["pos"].to_numpy()
        to_b = nearest(ap, bp)
        distance = np.abs(bp[to_b] - ap)
        width_, tol, here = int(a["width"][0].as_py()), a["tol"].to_numpy(), int(key_[1].as_py())
        keep = (distance <= tol) & (ap // width_ == here)
        if mutual:
            keep &= nearest(bp, ap)[to_b] == np.arange(len(ap))
        return pa.table(
            {
                "entity": a["entity"].filter(pa.array(keep)), "left_key": a["id"].filter(pa.array(keep)),
                "right_key": pa.array(b["id"].to_numpy()[to_b[keep]], pa.int64()), "distance": pa.array(distance[keep], pa.int64()),
            }
        )

    a, b = prepared(left, 2), prepared(right, 1)
    return (
        a.groupBy("entity", "range")
        .cogroup(b.groupBy("entity", "range"))
        .applyInArrow(join, "entity string, left_key bigint, right_key bigint, distance bigint")
        .withColumnRenamed("entity", entity)
    )
