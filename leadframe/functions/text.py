"""Scalar text functions: labels, elapsed times, start times, fixed-width lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standard_label(label: Column) -> Column:
    """Upper case, underscores as blanks: the form in which labels are compared."""
    return F.replace(F.upper(label), F.lit("_"), F.lit(" "))


def bare_lead(label: Column) -> Column:
    """A lead's name without blanks, underscores and hyphens."""
    return F.regexp_replace(F.upper(label), r"[_\s-]", "")


def elapsed(sample: Column, frequency: Column) -> Column:
    """HH:MM:SS.sss since the start of the record; null without a sample or a positive frequency."""
    ms = F.bround(sample.cast("double") * 1000 / F.when(frequency > 0, frequency)).cast("bigint")
    s = F.floor(ms / 1000)
    text = F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)
    return F.when(ms.isNotNull(), text)


def elapsed_short(sample: Column, frequency: Column) -> Column:
    """The constructor's form: seconds with as many decimals as they need (00:00:00.4); blank without a frequency."""
    full = elapsed(sample, frequency)
    return F.coalesce(F.regexp_replace(F.regexp_replace(full, r"0+$", ""), r"\.$", ""), F.lit(""))


def start_time(text: Column) -> Column:
    """The zoneless start time that a header or export line holds; null if it is none."""
    t = F.trim(F.regexp_replace(text, r"\.\d+(?= )", ""))
    forms = ("H:mm:ss d/M/yyyy", "M/d/yyyy h:mm:ss a", "MM-dd-yyyy HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in forms))


def start_line(time: Column) -> Column:
    """HH:MM:SS DD/MM/YYYY, as record lines have it."""
    return F.date_format(time, "HH:mm:ss dd/MM/yyyy")


def annotation_line(*columns: str) -> Column:
    """A fixed-width line of time, sample, type, subtype, channel, number; long values push the rest to the right."""
    return F.format_string("%12s%9s%6s%5s%5s%5s", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def make_unique(df: DataFrame, keys: list[str], label: str, order: str, name: str) -> DataFrame:
    """``name``: the label, from its second occurrence in the key on with _1, _2, ...; suffixes that are taken are passed over."""
    w = Window.partitionBy(*keys, label).orderBy(order)
    n = df.withColumn("_n", F.row_number().over(w) - 1)
    taken = df.groupBy(*keys).agg(F.collect_set(label).alias("_taken"))
    # The n-th repeat takes the n-th suffix that no label of the key has.
    free = F.filter(
        F.sequence(F.lit(1), F.col("_n") + F.size("_taken")), lambda i: ~F.array_contains(F.col("_taken"), F.concat(F.col(label), F.lit("_"), i.cast("string")))
    )
    pick = F.when(F.col("_n") > 0, F.concat(F.col(label), F.lit("_"), F.get(free, F.col("_n") - 1).cast("string"))).otherwise(F.col(label))
    return n.join(taken, keys).withColumn(name, pick).drop("_n", "_taken")
