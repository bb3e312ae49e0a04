"""Overlapping and gapped intervals per entity: pairing of bounds, continuous periods, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.operators.chunked import first_later, running

#: Positions per chunk of a key; a task of the windows below reads one chunk.
CHUNK = 1 << 16


def pair_bounds(
    marks: DataFrame,
    keys: Sequence[str],
    position: str,
    kind: str,
    opening: str = "(",
    closing: str = ")",
    chunk_width: int = CHUNK,
) -> DataFrame:
    """Intervals (keys, ``start``, ``stop``) from rows that mark bounds.

    An interval runs from an opening row to the first closing row of the same keys at a strictly greater position; a
    closing row may end several intervals. Rows with a null key or position are left out, as are openings that nothing
    closes. Equal rows count once. Extra columns are ignored.
    """
    m = (
        marks.filter(F.col(kind).isin(opening, closing) & F.col(position).isNotNull())
        .dropna(subset=list(keys))
        .select(*keys, F.col(position).alias("_pos"), (F.col(kind) == closing).alias("_close"))
        .withColumn("_chunk", F.floor(F.col("_pos") / chunk_width))
        .distinct()
    )
    m = first_later(m, keys, "_chunk", "_pos", F.when(F.col("_close"), F.col("_pos")), "_stop")
    return m.filter(~F.col("_close") & F.col("_stop").isNotNull()).select(
        *keys, F.col("_pos").alias("start"), F.col("_stop").alias("stop")
    )


def label_islands(intervals: DataFrame, keys: Sequence[str], chunk_width: int = CHUNK) -> DataFrame:
    """Add ``prev_stop`` (running maximum of earlier stops), ``is_new`` and ``island`` (start of the row's period).

    Rows are taken by (start, stop). A row opens a period if nothing precedes it or its start lies beyond every earlier
    stop; touching intervals share a period. Rows with a null key or bound or with stop before start are left out.
    """
    i = (
        intervals.filter(F.col("start") <= F.col("stop"))
        .select(*keys, "start", "stop")
        .distinct()
        .withColumn("_chunk", F.floor(F.col("start") / chunk_width))
    )
    order = [F.col("start"), F.col("stop")]
    i = running(i, keys, "_chunk", order, F.col("stop"), "max", "prev_stop")
    i = i.withColumn("is_new", F.col("prev_stop").isNull() | (F.col("start") > F.col("prev_stop")))
    opened = F.when(F.col("is_new"), F.col("start"))
    return running(i, keys, "_chunk", order, opened, "max", "island", inclusive=True).drop("_chunk")


def periods(intervals: DataFrame, keys: Sequence[str], chunk_width: int = CHUNK) -> DataFrame:
    """Continuous periods (keys, ``period_from``, ``period_to``, ``n_intervals``) of overlapping, nested and touching intervals."""
    return (
        label_islands(intervals, keys, chunk_width)
        .groupBy(*keys, "island")
        .agg(F.max("stop").alias("period_to"), F.count(F.lit(1)).alias("n_intervals"))
        .select(*keys, F.col("island").alias("period_from"), "period_to", "n_intervals")
    )


def gaps(intervals: DataFrame, keys: Sequence[str], chunk_width: int = CHUNK) -> DataFrame:
    """Gaps (keys, ``gap_from``, ``gap_to``) between successive periods of a key.

    Where a period opens, the running maximum of earlier stops is the end of the period before it, so no second pass
    over the periods is needed. A key with one period, an empty table and touching periods give no gap.
    """
    return (
        label_islands(intervals, keys, chunk_width)
        .filter(F.col("is_new") & F.col("prev_stop").isNotNull())
        .select(*keys, F.col("prev_stop").alias("gap_from"), F.col("start").alias("gap_to"))
    )
