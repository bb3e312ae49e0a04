"""Channel tables: labels, sources, units, palette, validation, selection, and the view made for plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadframe.functions.dims import LABELS, LEADS, SURFACE, lead_dim, palette_dim
from leadframe.functions.text import bare_lead, make_unique, standard_label


def with_sources(channels: DataFrame, key: str = "record_id", label: str = "label", number: str = "number", standard: bool = True) -> DataFrame:
    """Labels in standard form with ``lead_group``, ``source``, ``lead`` and display ``ord``.

    Only if all labels of a record are known do source and lead get values (a surface lead is its own lead); else both
    are null and repeated labels are made unique. Null labels are unknown. With ``standard`` off labels stay as they are.
    """
    dim = lead_dim(channels.sparkSession).withColumnRenamed("label", "_l")
    c = channels.drop("lead_group", "ord", "source", "lead").withColumn(label, standard_label(F.col(label)) if standard else F.col(label))
    c = c.join(F.broadcast(dim), c[label] == dim["_l"], "left").drop("_l")
    known = c.groupBy(key).agg(F.bool_and(F.col("ord").isNotNull()).alias("_all"))
    c = make_unique(c, [key], label, number, "_unique").join(known, key)
    return (
        c.withColumn("source", F.when(F.col("_all"), F.when(F.col("lead_group") == "ECG", "ECG").otherwise(F.split(label, " ")[0])))
        .withColumn("lead", F.when(F.col("_all"), F.when(F.col("lead_group") == "ECG", F.col(label)).otherwise(F.split(label, " ")[1])))
        .withColumn(label, F.when(F.col("_all"), F.col(label)).otherwise(F.col("_unique")))
        .drop("_all", "_unique")
    )


def gain_of_range(saturation: Column, additional_gain: Column, gain: Column) -> Column:
    """Counts per unit: saturation over the channel's range where both are usable, else the stated gain."""
    return F.when((saturation > 0) & (additional_gain > 0), saturation / additional_gain).otherwise(gain)


def channel_counts(records: DataFrame, channels: DataFrame, key: str = "record_id", stated: str = "number_of_channels") -> DataFrame:
    """(key, ``number_of_channels``): as stated, or the channels counted where it is null or 0."""
    counted = channels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.when(F.col(stated) > 0, F.col(stated)).otherwise(F.coalesce("_n", F.lit(0))).cast("int")
    return records.join(counted, key, "left").select(key, n.alias("number_of_channels"))


def channel_source(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``lead_group`` of each label; null where it is unknown."""
    dim = lead_dim(df.sparkSession).select(F.col("label").alias("_l"), "lead_group")
    df = df.drop("lead_group")
    return df.join(F.broadcast(dim), df[label] == F.col("_l"), "left").drop("_l")


def with_colors(channels: DataFrame, keys: Sequence[str] = ("record_id",), label: str = "label", order: str = "number", mode: str = "dark",
                palette: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add ``color``: the i-th distinct lead of a group in a record takes the group's i-th shade; unknown labels none.

    ``palette`` gives shades by group instead of the material ones; groups that it does not have get none.
    """
    spark = channels.sparkSession
    c = channel_source(channels.drop("color"), label)
    first = c.filter(F.col("lead_group").isNotNull()).groupBy(*keys, label, "lead_group").agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*keys, "lead_group").orderBy("_first")
    shade = first.withColumn("i", F.row_number().over(w) - 1).join(F.broadcast(palette_dim(spark, mode, palette)), ["lead_group", "i"])
    return c.join(shade.select(*keys, label, "color"), [*keys, label], "left")


def ecg_warnings(channels: DataFrame, key: str = "record_id", label: str = "label") -> DataFrame:
    """Per record ``n_leads``, ``unknown`` (sorted names that are no surface leads), ``warning`` (null: a proper 12-lead record).

    The count is looked at first; names only if there are twelve.
    """
    unknown = F.when(~bare_lead(F.col(label)).isin(*SURFACE), F.col(label))
    r = channels.groupBy(key).agg(F.count(F.lit(1)).alias("n_leads"), F.array_sort(F.collect_set(unknown)).alias("unknown"))
    return r.withColumn(
        "warning",
        F.when(F.col("n_leads") != 12, F.concat(F.lit("expected 12 leads, found "), F.col("n_leads").cast("string"))).when(
            F.size("unknown") > 0, F.concat(F.lit("unknown leads: "), F.array_join("unknown", ", "))
        ),
    )


def surface_leads(channels: DataFrame, key: str = "record_id", label: str = "label", lead: str | None = None, every: bool = False) -> DataFrame:
    """The channels to analyse: the given lead, all of them, or those whose name is a surface lead."""
    if lead is not None:
        return channels.filter(F.col(label) == lead)
    return channels if every else channels.filter(bare_lead(F.col(label)).isin(*SURFACE))


def select_channels(channels: DataFrame, wanted: Sequence[str | int], key: str = "record_id", label: str = "label", number: str = "number") -> DataFrame:
    """Channels by name or 1-based place, in the order asked for (``pick``), repeats allowed.

    A name is matched exactly, and without regard to case only where a record has no exact match. Requests that match
    nothing give no row; :func:`leadframe.api.read_signal` refuses them.
    """
    spark = channels.sparkSession
    asked = spark.createDataFrame(
        [(i, None if isinstance(x, int) else x, x if isinstance(x, int) else None) for i, x in enumerate(wanted)], "pick int, _name string, _place int"
    )
    placed = channels.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(number)))
    by_place = placed.join(F.broadcast(asked), placed["_at"] == F.col("_place")).withColumn("_exact", F.lit(True))
    by_name = placed.join(F.broadcast(asked), F.lower(label) == F.lower("_name")).withColumn("_exact", F.col(label) == F.col("_name"))
    both = by_place.unionByName(by_name)
    w = Window.partitionBy(key, "pick").orderBy(F.desc("_exact"), number)
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_at", "_name", "_place", "_exact", "_k")


def matching(label: Column, wanted: Sequence[str]) -> Column:
    """Known labels match whole, other requests as a pattern anywhere in the label; no request matches everything."""
    if not wanted:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (label == w if w in LABELS else label.rlike(w) for w in wanted))


def scales(channels: DataFrame, meant: DataFrame | None = None, label: str = "label") -> DataFrame:
    """(record_id, label, gain, base, fmt) per channel: of several with one label the last stated gain and baseline.

    ``meant`` has (``label``, ``canonical``) for labels typed by hand: a channel goes by that label where it is not null,
    otherwise by its own in standard form, which counts before typed ones.
    """
    c = channels.withColumn("_own", standard_label(F.col(label)))
    if meant is not None:
        m = meant.select(F.col("label").alias(label), F.col("canonical").alias("_meant")).dropna()
        c = c.join(m, label, "left").withColumn("_typed", F.col("_meant").isNotNull() & (F.col("_meant") != F.col("_own")))
    else:
        c = c.withColumn("_meant", F.lit(None).cast("string")).withColumn("_typed", F.lit(False))
    c = c.withColumn("_label", F.coalesce("_meant", "_own"))
    pick = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(~F.col("_typed"), F.col("number"))))
    return c.groupBy("record_id", F.col("_label").alias("label")).agg(pick("adc_gain").alias("gain"), pick("adc_baseline").alias("base"), F.max("storage_format").alias("fmt"))


def to_physical(value: Column, gain: Column, baseline: Column) -> Column:
    """(value - baseline) / gain; no baseline counts as 0, a gain of 0 divides nothing, a null gain is 200."""
    g = F.coalesce(gain, F.lit(200.0))
    moved = value - F.coalesce(baseline, F.lit(0))
    return F.when(g == 0, moved.cast("double")).otherwise(moved / F.when(g != 0, g))


#: Least and greatest count of each storage format.
FORMAT_RANGE = {8: (-128, 127), 80: (-128, 127), 16: (-32768, 32767), 24: (-8388608, 8388607), 32: (-2147483648, 2147483647), 212: (-2048, 2047)}


def to_digital(value: Column, gain: Column, baseline: Column, storage_format: Column) -> Column:
    """Counts: value * gain + baseline (a gain of 0 multiplies nothing, a null one is 200), rounded half away from zero, held within the range of the storage format; a null stays."""
    g = F.coalesce(gain, F.lit(200.0))
    counts = F.round(value * F.when(g == 0, 1.0).otherwise(g) + F.coalesce(baseline, F.lit(0)))
    low = reduce(lambda acc, kv: F.when(storage_format == kv[0], kv[1][0]).otherwise(acc), FORMAT_RANGE.items(), F.lit(None).cast("int"))
    high = reduce(lambda acc, kv: F.when(storage_format == kv[0], kv[1][1]).otherwise(acc), FORMAT_RANGE.items(), F.lit(None).cast("int"))
    return F.when(counts.isNotNull(), F.greatest(F.least(counts, high), low)).cast("int")


def derived_leads(wide: DataFrame, one: str = "i", two: str = "ii") -> DataFrame:
    """Add III, aVR, aVL and aVF from leads I and II."""
    i, ii = F.col(one), F.col(two)
    return wide.withColumns({"iii": ii - i, "avr": -(i + ii) / 2, "avl": i - ii / 2, "avf": ii - i / 2})


def long_signal(wide: DataFrame, labels: Sequence[str], key: str = "record_id", value: str = "value") -> DataFrame:
    """Wide to long; pick ``labels`` first, as a filter on the label would not reach the scan."""
    return wide.select(key, "sample", *labels).unpivot([key, "sample"], list(labels), "label", value)


def wide_signal(long: DataFrame, labels: Sequence[str], key: str = "record_id", value: str = "value") -> DataFrame:
    """Long to wide, one column per label."""
    return long.groupBy(key, "sample").pivot("label", list(labels)).agg(F.first(value, ignorenulls=True))


def signal_arrays(long: DataFrame, key: str = "record_id", value: str = "value") -> DataFrame:
    """(key, ``label``, ``first_sample``, ``values``): each channel as one array in order of sample.

    For operators that need a whole channel at once; a record of hours belongs in :func:`over_blocks` instead.
    """
    s = long.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("sample", F.col(value).alias("v")))).alias("_s"))
    return s.select(key, "label", F.col("_s")[0]["sample"].alias("first_sample"), F.transform("_s", lambda x: x["v"]).alias("values"))


def plot_data(
    long: DataFrame, channels: DataFrame, records: DataFrame, wanted: Sequence[str] = (), frame_s: tuple[float, float] | None = None, key: str = "record_id", value: str = "mv"
) -> DataFrame:
    """Rows ready to plot: samples within the time frame, chosen channels, channel facts, ``time`` in seconds, ``ord``.

    The frame is closed and goes by whole samples. Channels are joined by (key, label); samples without a channel row
    stay. Unknown labels come last.
    """
    s = long.select(key, "label", "sample", value).filter(matching(F.col("label"), wanted)).join(records.select(key, "frequency"), key)
    if frame_s is not None:
        s = s.filter(F.col("sample").between(F.bround(frame_s[0] * F.col("frequency")), F.bround(frame_s[1] * F.col("frequency"))))
    s = s.withColumn("time", F.col("sample") / F.col("frequency"))
    facts = channels.withColumn("label", standard_label(F.col("label"))).groupBy(key, "label").agg(F.min("number").alias("number"))
    dim = lead_dim(long.sparkSession)
    return s.join(facts, [key, "label"], "left").join(F.broadcast(dim), "label", "left").withColumn("ord", F.coalesce("ord", F.lit(len(LABELS))))


GROUPS = tuple(LEADS)
