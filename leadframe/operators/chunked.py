"""Running aggregates over very long keys, in two levels.

A plain window over a key reads the whole key in one task, so a key that holds a third of a table sets the time of the
job. Here a key is cut into chunks along its order; the window runs within (key, chunk), one summary row per chunk goes
through a second, tiny window over the key, and its result is joined back. Each task sees one chunk, and the only rows
that meet per key are the summaries. The result is exactly that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_COMBINE = {"max": F.greatest, "min": F.least}
_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def _placed(df: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """Rows with a key and a chunk. Said as plain conditions: the join asks the same of the summaries, so that both sides
    read one and the same shuffle."""
    return df.filter(reduce(and_, (F.col(c).isNotNull() for c in (*keys, chunk))))


def _carry(df: DataFrame, keys: Sequence[str], chunk: str, value: Column, agg: str, backward: bool) -> DataFrame:
    """One row per (keys, chunk): the aggregate of ``value`` over all chunks before (after) it."""
    w = Window.partitionBy(*keys).orderBy(F.col(chunk).desc() if backward else F.col(chunk).asc())
    return (
        df.groupBy(*keys, chunk)
        .agg(_AGG[agg](value).alias("_v"))
        .select(*keys, chunk, _AGG[agg]("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    value: Column,
    agg: str,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``name``: the running ``agg`` (max, min, sum) of ``value`` over the earlier rows of the key.

    ``chunk`` is a column that never falls as ``order`` rises. Nulls in ``value`` are skipped; a row with nothing
    before it gets null (sum: 0). Rows with a null key belong to no key and are left out: joins on the plain key keep
    the partitioning and the order that the window made. An empty table gives an empty table.
    """
    df = _placed(df, keys, chunk)
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    carry = _carry(df, keys, chunk, value, agg, False)
    return _combine(df.withColumn("_local", _AGG[agg](value).over(w)), carry, keys, chunk, agg, name)


def first_later(df: DataFrame, keys: Sequence[str], chunk: str, position: str, value: Column, name: str) -> DataFrame:
    """Add ``name``: the least ``value`` among rows of the key whose ``position`` is strictly greater.

    ``value`` must be null or the position itself, so that values of later chunks are all greater. Rows with a null key are
    left out.
    """
    df = _placed(df, keys, chunk)
    w = Window.partitionBy(*keys, chunk).orderBy(-F.col(position)).rangeBetween(Window.unboundedPreceding, -1)
    carry = _carry(df, keys, chunk, value, "min", True)
    return _combine(df.withColumn("_local", F.min(value).over(w)), carry, keys, chunk, "min", name)


def _combine(df: DataFrame, carry: DataFrame, keys: Sequence[str], chunk: str, agg: str, name: str) -> DataFrame:
    both = df.join(carry, [*keys, chunk], "left")
    if agg == "sum":
        out = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        out = _COMBINE[agg](F.col("_local"), F.col("_carry"))
    return both.select(*[c for c in df.columns if c not in ("_local", name)], out.alias(name))


def ranked(df: DataFrame, keys: Sequence[str], position: str, chunk_width: int = 1 << 16) -> DataFrame:
    """Distinct rows with ``rank``, their number within the key from 0, by ``position`` and then the other columns.

    Rows with a null key or position are left out.
    """
    df = df.dropna(subset=[*keys, position])
    rest = [F.col(c) for c in df.columns if c not in (*keys, position)]
    r = df.distinct().withColumn("_chunk", F.floor(F.col(position) / chunk_width))  # copies go before the shuffle by chunk
    return running(r, keys, "_chunk", [F.col(position), *rest], F.lit(1), "sum", "rank").drop("_chunk")


def blocks(df: DataFrame, keys: Sequence[str], position: str, margin: int, block: int = 1 << 15) -> DataFrame:
    """Distinct rows with ``rank``, ``_b`` (their block) and ``_block`` (each block they go to: their own, and a
    neighbour's whose margin they are in). Windows that reach no further than ``margin`` rows do not depend on ``block``."""
    if margin > block:
        raise ValueError("a block must be at least as long as the margin")
    r = ranked(df, keys, position).withColumn("_b", F.floor(F.col("rank") / block))
    at = F.col("rank") % block
    copies = F.array_compact(
        F.array(F.col("_b"), F.when((at < margin) & (F.col("_b") > 0), F.col("_b") - 1), F.when(at >= block - margin, F.col("_b") + 1))
    )
    return r.withColumn("_block", F.explode(copies))


def over_blocks(
    df: DataFrame, keys: Sequence[str], position: str, margin: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = 1 << 15
) -> DataFrame:
    """Distinct rows of ``df`` with window columns whose frames reach at most ``margin`` rows to either side.

    ``columns`` gets a window over (key, block) in order of ``position``; later columns may use earlier ones, their
    reaches then add up. A key of any length is spread over as many tasks as it has blocks.
    """
    out = blocks(df, keys, position, margin, block)
    w = Window.partitionBy(*keys, "_block").orderBy("rank")
    for name, c in columns(w).items():
        out = out.withColumn(name, c)
    return out.filter(F.col("_b") == F.col("_block")).drop("_b", "_block", "rank")
