"""Peaks, intervals and filters along a channel, each spread over blocks of the channel.

Readings that are not finite, or beyond ``bound``, keep their place and count as missing: nothing is compared with them,
sums and slopes take 0 in their place, and statistics leave them out.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadframe.functions.expr import BOUND, sound
from leadframe.operators.chunked import blocks, over_blocks

KEYS = ("record_id", "label")


def local_maxima(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings that are greater than both neighbours; plateaus, neighbours of missing readings and the ends are none."""
    out = over_blocks(signal, keys, "sample", 1, lambda w: {"_a": F.lag(value).over(w), "_b2": F.lead(value).over(w)})
    return out.filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b2"))).drop("_a", "_b2")


def find_peaks(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS, factor: float = 2.0, bound: float | None = BOUND) -> DataFrame:
    """Local maxima of the absolute value beyond mean + ``factor`` standard deviations of the channel."""
    s = signal.withColumn("_abs", F.abs(sound(value, bound)))
    level = s.groupBy(*keys).agg((F.avg("_abs") + factor * F.stddev_samp("_abs")).alias("_level"))
    return local_maxima(s, "_abs", keys).join(level, list(keys)).filter(F.col("_abs") > F.col("_level")).drop("_abs", "_level")


def derivative(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS, frequency: str = "frequency", name: str = "slope", bound: float | None = BOUND) -> DataFrame:
    """Causal five-point slope: (-x0 - 2 x1 + 2 x3 + x4) * frequency / 8 over the reading and the four before it; missing ones count 0."""
    taps = ((0, -1.0), (1, -2.0), (3, 2.0), (4, 1.0))
    return over_blocks(
        signal, keys, "sample", 4,
        lambda w: {name: sum((c * F.coalesce(sound(F.lag(value, k).over(w) if k else F.col(value), bound), F.lit(0.0)) for k, c in taps), F.lit(0.0)) * F.col(frequency) / 8},
    )


def moving_integral(signal: DataFrame, value: str, length: int, keys: Sequence[str] = KEYS, name: str = "integral", bound: float | None = BOUND) -> DataFrame:
    """Sum of the reading and the ``length`` - 1 before it, over ``length``, at the start too."""
    total = lambda w: F.coalesce(F.sum(sound(value, bound)).over(w.rowsBetween(1 - length, 0)), F.lit(0.0))
    return over_blocks(signal, keys, "sample", length, lambda w: {name: total(w) / length})


def moving_integral_s(
    signal: DataFrame, value: str, seconds: float = 0.150, keys: Sequence[str] = KEYS, frequency: str = "frequency", name: str = "integral", bound: float | None = BOUND, most: int = 1 << 12
) -> DataFrame:
    """:func:`moving_integral` over ``seconds`` of each channel's own ``frequency``, in whole readings (half to even, from
    1 to ``most``). Channels without a positive frequency are left out; a length beyond ``most`` is an error."""
    n = F.greatest(F.bround(F.lit(float(seconds)) * F.col(frequency)), F.lit(1.0))
    n = F.when(n <= most, n).otherwise(F.raise_error(F.lit(f"more than {most} readings to integrate")).cast("double"))
    b = blocks(signal.filter(F.col(frequency) > 0), keys, "sample", most).withColumn("_len", n)
    # On the scale of lengths the reading ``_len`` - 1 places back is 1 - 1 / _len away, the one before it a whole 1.
    b = b.withColumn("_at", F.col("rank") / F.col("_len")).withColumn("_v", F.coalesce(sound(value, bound), F.lit(0.0)))
    own = ", ".join(f"`{k}`" for k in (*keys, "_block"))
    total = F.expr(f"sum(_v) OVER (PARTITION BY {own} ORDER BY _at RANGE BETWEEN {1 - 0.5 / most!r}D PRECEDING AND CURRENT ROW)")
    b = b.withColumn(name, total / F.col("_len")).drop("_at", "_v")
    return b.filter(F.col("_b") == F.col("_block")).drop("_b", "_block", "rank", "_len")


def rising(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS, factor: float = 0.5, bound: float | None = BOUND) -> DataFrame:
    """Readings above mean + ``factor`` standard deviations that lie between a lower one before and a higher one after."""
    s = signal.withColumn("_v", sound(value, bound))
    level = s.groupBy(*keys).agg((F.avg("_v") + factor * F.stddev_samp("_v")).alias("_level"))
    out = over_blocks(s, keys, "sample", 1, lambda w: {"_a": F.lag("_v").over(w), "_z": F.lead("_v").over(w)})
    out = out.join(level, list(keys))
    return out.filter((F.col("_a") < F.col("_v")) & (F.col("_z") > F.col("_v")) & (F.col("_v") > F.col("_level"))).drop("_a", "_z", "_v", "_level")


def apart(points: DataFrame, refractory: int | Column, keys: Sequence[str] = KEYS, width: int = 1 << 16) -> DataFrame:
    """Points taken greedily from the start, each at least ``refractory`` samples after the last one taken.
    ``refractory`` may be a column that is alike for all points of a key. Equal points count once, null ones not at all.

    A key is cut into ranges of ``width`` samples. A range tells, for each point that may be the first one taken in it, the
    last one then taken; these tables chain along the key, and each range is then walked from the entry found for it.
    """
    step = refractory if isinstance(refractory, Column) else F.lit(refractory)
    p = points.select(*keys, F.col("sample").cast("bigint").alias("_s"), step.cast("bigint").alias("_step")).dropna().distinct()
    p = p.withColumn("_c", F.floor(F.col("_s") / width))
    kinds = dict(p.dtypes)
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def following(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        s, d = np.sort(t["_s"].to_numpy()), max(t["_step"][0].as_py(), 1)
        return s, np.searchsorted(s, s + d), d

    def entries(t: pa.Table) -> pa.Table:
        s, after, d = following(t)
        last = np.where(after < len(s), after, np.arange(len(s)))
        while (last[last] != last).any():
            last = last[last]
        some = slice(0, np.searchsorted(s, t["_c"][0].as_py() * width + d) + 1)  # whatever went before, one of these is the first
        head = t.select([*keys, "_c", "_step"]).slice(0, 1)
        return head.append_column("_in", pa.array([s[some].tolist()], pa.list_(pa.int64()))).append_column("_out", pa.array([s[last[some]].tolist()], pa.list_(pa.int64())))

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("_c")
        d, taken, enter = max(t["_step"][0].as_py(), 1), None, []
        for first, last in zip(t["_in"].to_pylist(), t["_out"].to_pylist(), strict=True):
            at = 0 if taken is None else bisect.bisect_left(first, taken + d)
            enter.append(first[at] if at < len(first) else None)
            taken = last[at] if at < len(first) else taken
        return t.select([*keys, "_c"]).append_column("_enter", pa.array(enter, pa.int64()))

    def walk(t: pa.Table) -> pa.Table:
        s, after, _ = following(t)
        at, out = int(np.searchsorted(s, t["_enter"][0].as_py())), []
        while at < len(s):
            out.append(int(s[at]))
            at = int(after[at])
        cols = {k: pa.array([t[k][0].as_py()] * len(out), t.schema.field(k).type) for k in keys}
        return pa.table(cols | {"sample": pa.array(out, pa.int32())})

    table = p.groupBy(*keys, "_c").applyInArrow(entries, f"{own}, _c bigint, _step bigint, _in array<bigint>, _out array<bigint>")
    enter = table.groupBy(*keys).applyInArrow(chain, f"{own}, _c bigint, _enter bigint").dropna()
    return p.join(enter, [*keys, "_c"]).groupBy(*keys, "_c").applyInArrow(walk, f"{own}, sample int")


def intervals_between(points: DataFrame, keys: Sequence[str] = ("record_id",), name: str = "rr") -> DataFrame:
    """Distance of each point to the one before it; null for the first."""
    return over_blocks(points.select(*keys, "sample"), keys, "sample", 1, lambda w: {name: F.col("sample") - F.lag("sample").over(w)})


def aberrant(points: DataFrame, keys: Sequence[str] = ("record_id",), share: float = 0.4) -> DataFrame:
    """Intervals with ``median_rr`` of the key and ``is_aberrant``: further than ``share`` of the median from it; the first never.

    The median is exact, from counts by length: lengths are whole samples, so that a key of any size has few different ones.
    """
    rr = intervals_between(points, keys)
    median = rr.groupBy(*keys).agg(F.median("rr").alias("median_rr"))
    return rr.join(median, list(keys)).withColumn("is_aberrant", F.coalesce(F.abs(F.col("rr") - F.col("median_rr")) > share * F.col("median_rr"), F.lit(False)))


def embedded(signal: DataFrame, m: int = 3, value: str = "mv", keys: Sequence[str] = KEYS) -> DataFrame:
    """Vectors of ``m`` successive readings, ``v0`` to ``v{m-1}``; none where readings run out."""
    out = over_blocks(signal, keys, "sample", m, lambda w: {f"v{k}": F.lead(value, k).over(w) if k else F.col(value) for k in range(m)} | {"_rest": F.count(F.lit(1)).over(w.rowsBetween(0, m - 1))})
    return out.filter(F.col("_rest") == m).drop("_rest")


def channel_stats(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per channel: readings, RMS, mean, sample deviation, thresholds, 99 % quantile, range, mean absolute value; nulls, nan and infinities left out.

    The quantile is exact, from counts by value: readings are converter counts over a gain, so that a channel of any length has at
    most as many different ones as its converter has codes (65,536 of 16 bits).
    """
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return signal.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        (F.avg(v) + 0.5 * F.stddev_samp(v)).alias("qrs_threshold"), (3.5 * F.stddev_samp(v)).alias("entropy_tolerance"),
        F.percentile(v, 0.99).alias("q99"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(F.abs(v)).alias("mean_abs"),
    )


def argmax(signal: DataFrame, value: str = "mv", keys: Sequence[str] = KEYS) -> DataFrame:
    """The sample of the greatest finite reading per channel; the first of equals."""
    s = signal.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return s.groupBy(*keys).agg(F.max_by("sample", F.struct(F.col(value), -F.col("sample"))).alias("sample"), F.max(value).alias("greatest"))


def first_samples(signal: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first ``n`` rows of each key by sample."""
    w = Window.partitionBy(*keys).orderBy("sample")
    return signal.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
