"""Annotation tables: selection, decoding, intervals, wave bounds, rhythm windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.functions.dims import annotation_dim
from leadframe.functions.text import elapsed_short
from leadframe.operators.chunked import first_later, over_blocks, running

#: Samples per chunk of a record.
CHUNK = 1 << 16


def filled(annotations: DataFrame, frequency: str | None = None) -> DataFrame:
    """Missing type and subtype blank, missing channel and number 0, missing time from sample and ``frequency``."""
    a = annotations.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("type", "subtype")} | {c: F.coalesce(c, F.lit(0)) for c in ("channel", "number")}
    )
    return a.withColumn("time", F.coalesce("time", elapsed_short(F.col("sample"), F.col(frequency)) if frequency else F.lit("")))


def criteria(df: DataFrame, wanted: Mapping[str, object]) -> Column:
    """All of the given columns equal the given values; a column that is not there is an error."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"no such annotation column: {', '.join(missing)}")
    if not wanted:
        raise ValueError("at least one criterion is needed")
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in wanted.items()))


def within_time(annotations: DataFrame, begin_s: float = 0.0, end_s: float | None = None, frequency: str = "frequency") -> DataFrame:
    """Rows from floor(begin * frequency) to ceiling(end * frequency), both included."""
    a = annotations.filter((F.col(frequency) > 0) & (F.col("sample") >= F.floor(F.lit(begin_s) * F.col(frequency))))
    return a if end_s is None else a.filter(F.col("sample") <= F.ceil(F.lit(end_s) * F.col(frequency)))


def decoded(annotations: DataFrame, column: str = "type") -> DataFrame:
    """Left join to the annotation codes; a number column is read as the code, any other as the symbol."""
    if column not in annotations.columns:
        raise ValueError(f"no such annotation column: {column}")
    dim = annotation_dim(annotations.sparkSession)
    numeric = dict(annotations.dtypes)[column] in ("int", "bigint", "smallint", "tinyint")
    return annotations.join(F.broadcast(dim), F.col(column) == dim["label_store" if numeric else "symbol"], "left")


def numbered_bounds(annotations: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """(keys, ``wave``, ``beat``, ``onset``, ``offset``): the n-th opening and the n-th closing of a wave are one row.

    Waves go by number: 0 p, 1 qrs, 2 t, else the number as text. Rows are counted by sample within wave and kind.
    """
    wave = F.when(F.col("number") == 0, "p").when(F.col("number") == 1, "qrs").when(F.col("number") == 2, "t").otherwise(F.col("number").cast("string"))
    b = (
        annotations.filter(F.col("type").isin("(", ")") & F.col("sample").isNotNull() & F.col("number").isNotNull())
        .select(*keys, wave.alias("wave"), "type", "sample", "ann_id")
        .withColumn("_chunk", F.floor(F.col("sample") / CHUNK))
    )
    b = running(b, [*keys, "wave", "type"], "_chunk", [F.col("sample"), F.col("ann_id")], F.lit(1), "sum", "_n", inclusive=True)
    return (
        b.groupBy(*keys, "wave", F.col("_n").alias("_k"))
        .agg(F.max(F.when(F.col("type") == "(", F.col("sample"))).alias("onset"), F.max(F.when(F.col("type") == ")", F.col("sample"))).alias("offset"))
        .select(*keys, "wave", F.concat("wave", F.col("_k").cast("string")).alias("beat"), "onset", "offset")
    )


def waves_by_neighbour(annotations: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Bounds named by the mark beside them: an opening by the type after it, a closing by the type before it."""
    a = annotations.filter(F.col("sample").isNotNull()).select(*keys, "sample", "ann_id", "type", "number")
    out = over_blocks(a, keys, "sample", 2, lambda w: {"_next": F.lead("type").over(w), "_prev": F.lag("type").over(w)})
    wave = F.when(F.col("type") == "(", F.col("_next")).otherwise(F.col("_prev"))
    wave = F.when(wave == "N", "qrs").otherwise(wave)
    return out.filter(F.col("type").isin("(", ")")).select(*keys, "ann_id", "sample", "type", wave.alias("wave"))


def in_waves(signal: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("record_id",), width: int = 512) -> DataFrame:
    """Add ``wave`` and ``beat`` to samples from onset (included) to offset; elsewhere null.

    Both sides meet by key and range of samples, so that a long record is not one group: the bounds that touch a range are one
    array, in which each of its samples is looked up. Where bounds overlap the one with the latest onset, then the
    greatest name, stays. Rows of the signal stay as they are, copies too.
    """
    b = bounds.filter(F.col("onset") < F.col("offset"))
    b = b.withColumn("_r", F.explode(F.sequence(F.floor(F.col("onset") / width), F.floor((F.col("offset") - 1) / width))))
    b = b.groupBy(*keys, "_r").agg(F.collect_set(F.struct("onset", "beat", "wave", "offset")).alias("_bounds"))
    s = signal.drop("wave", "beat").withColumn("_r", F.floor(F.col("sample") / width)).join(b, [*keys, "_r"], "left")
    inside = F.filter("_bounds", lambda x: (x["onset"] <= F.col("sample")) & (F.col("sample") < x["offset"]))
    s = s.withColumn("_b", F.array_max(inside))
    return s.select(*(c for c in signal.columns if c not in ("wave", "beat")), F.col("_b.wave").alias("wave"), F.col("_b.beat").alias("beat"))


def rhythm_windows(
    annotations: DataFrame,
    onset: Mapping[str, object],
    offset: Mapping[str, object],
    reference: Mapping[str, object] | None = None,
    rhythm: str = "sinus",
    key: str = "record_id",
) -> DataFrame:
    """(key, ``window_id``, ``onset``, ``offset``, ``qrs``, ``window_record_name``), one row per window.

    A window runs from an onset to the first later offset; with ``reference`` a reference point must lie strictly between
    (the first is ``qrs``); in the sinus rhythm no other onset may lie strictly between. Windows are numbered by onset.
    Points without a sample do not count. Several onsets at one sample give one window each.
    """
    marks = [onset, offset, *([reference] if reference else [])]
    used = sorted({c for m in marks for c in m} | {"ann_id"})
    on, off = criteria(annotations, onset), criteria(annotations, offset)
    ref = criteria(annotations, reference) if reference else F.lit(False)
    a = annotations.filter(F.col("sample").isNotNull()).select(key, "sample", *used).distinct()
    a = a.withColumn("_on", on).withColumn("_off", off).withColumn("_ref", ref)
    a = a.filter(F.col("_on") | F.col("_off") | F.col("_ref")).withColumn("_chunk", F.floor(F.col("sample") / CHUNK))
    for flag, name in (("_off", "offset"), ("_ref", "qrs"), ("_on", "_next_on")):
        a = first_later(a, [key], "_chunk", "sample", F.when(F.col(flag), F.col("sample")), name)
    keep = F.col("_on") & F.col("offset").isNotNull()
    if reference:
        keep = keep & (F.col("qrs") < F.col("offset"))
    if rhythm == "sinus":
        keep = keep & (F.col("_next_on").isNull() | (F.col("_next_on") >= F.col("offset")))
    w = running(a.filter(keep), [key], "_chunk", [F.col("sample"), F.col("ann_id")], F.lit(1), "sum", "window_id", inclusive=True)
    qrs = F.col("qrs") if reference else F.lit(None).cast("int")
    return w.select(
        key, F.col("window_id").cast("int").alias("window_id"), F.col("sample").alias("onset"), "offset", qrs.alias("qrs"),
        F.concat(F.col(key), F.lit(f"_{rhythm}"), F.col("window_id").cast("string")).alias("window_record_name"),
    )


def _in_windows(rows: DataFrame, windows: DataFrame, key: str, width: int) -> DataFrame:
    w = windows.select(F.col(key).alias("_key"), F.col("window_id").alias("_id"), F.col("onset").alias("_on"), F.col("offset").alias("_off"))
    w = w.withColumn("_range", F.explode(F.sequence(F.floor(F.col("_on") / width), F.floor(F.col("_off") / width))))
    r = rows.withColumn("_r", F.floor(F.col("sample") / width))
    on = (F.col(key) == F.col("_key")) & (F.col("_r") == F.col("_range")) & F.col("sample").between(F.col("_on"), F.col("_off"))
    kept = [c for c in rows.columns if c not in ("window_id", "onset")]
    return r.join(w, on).select(*(f"`{c}`" for c in kept), F.col("_id").alias("window_id"), F.col("_on").alias("onset"))


def window_signal(signal: DataFrame, windows: DataFrame, key: str = "record_id", width: int = 1024) -> DataFrame:
    """Signal rows from onset to offset of each window, both included, with ``window_id``; samples keep their numbers."""
    return _in_windows(signal, windows, key, width).drop("onset")


def window_annotations(annotations: DataFrame, windows: DataFrame, key: str = "record_id", width: int = 1024, adjust: bool = True) -> DataFrame:
    """Annotation rows of each window; samples count from 1 at the window's onset unless ``adjust`` is off."""
    a = _in_windows(annotations, windows, key, width)
    return (a.withColumn("sample", F.col("sample") - F.col("onset") + 1) if adjust else a).drop("onset")


def concat_windows(*parts: DataFrame, key: str = "record_id") -> DataFrame:
    """Windows of several tables, numbered anew within the record in order of table, onset and number."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    both = both.withColumn("_chunk", F.col("_part").cast("bigint") * (1 << 40) + F.floor(F.col("onset") / CHUNK))
    out = running(both, [key], "_chunk", [F.col("_part"), F.col("onset"), F.col("window_id")], F.lit(1), "sum", "_new", inclusive=True)
    return out.withColumn("window_id", F.col("_new").cast("int")).drop("_part", "_chunk", "_new")


def peak_to_peak(signal: DataFrame, value: str = "mv", keys: Sequence[str] = ("record_id", "window_id", "label")) -> DataFrame:
    """Greatest minus least finite value per group."""
    v = F.when(~F.isnan(value), F.col(value))
    return signal.groupBy(*keys).agg((F.max(v) - F.min(v)).alias("peak_to_peak"))


def neighbourhoods(points: DataFrame, signal: DataFrame, reach: int, key: str = "record_id", value: str = "mv") -> DataFrame:
    """Samples within ``reach`` of each point, with ``k`` from -reach to reach; outside the record there is no row."""
    p = points.select(key, F.col("sample").alias("point")).distinct()
    p = p.withColumn("k", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("sample", F.col("point") + F.col("k"))
    return p.join(signal, [key, "sample"])
