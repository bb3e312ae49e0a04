"""Vendor exports: a comma-separated log with a header (bard), a pair of text files (prucka), and XML (muse)."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadframe.functions.expr import let
from leadframe.functions.text import standard_label, start_time
from leadframe.sources import files

#: Saturation of the vendors' 16-bit converters.
SATURATION = 32768
#: Lines before the first channel of a bard export, and lines per channel.
_HEAD, _PER_CHANNEL = 13, 8


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, no, line): the lines of text files with their numbers from 0, whatever pieces a file is read in.

    A line's number is its place in its piece plus the lines of the pieces before it; only one row per piece meets per file.
    """
    f = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    pieces = f.groupBy("_file", "_piece").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_file", "_piece", (before - F.col("_first")).alias("_move"))
    name = F.regexp_extract("_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return f.join(pieces, ["_file", "_piece"]).select(name.alias("record_id"), (F.col("_id") + F.col("_move")).alias("no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def _together(lines: DataFrame) -> DataFrame:
    """(record_id, l): the lines of each record as an array; for headers."""
    a = lines.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("_l"))
    return a.select("record_id", F.transform("_l", lambda x: x["line"]).alias("l"))


def _data_from(lines: DataFrame) -> DataFrame:
    """(record_id, _from): the number of the line [Data]."""
    return lines.filter(F.trim("line") == "[Data]").groupBy("record_id").agg(F.min("no").alias("_from"))


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def _value(lines: Column, key: str, separator: str) -> Column:
    """What stands behind the first line ``key``; null if there is none."""
    hit = F.filter(lines, lambda x: F.trim(F.split(x, separator, 2)[0]) == key)
    return F.trim(F.split(F.get(hit, F.lit(0)), separator, 2)[1])


# ---- bard ------------------------------------------------------------------------------------------------------------


def read_bard_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, channels) of bard exports.

    The sample count may be followed by a clock of eight characters; rates and filters by Hz, ranges by mv. A channel's
    gain is the saturation over its range. ``count_mismatch`` tells records whose stated and listed channels differ.
    """
    lines = _lines(spark, path)
    head = lines.join(_data_from(lines), "record_id", "left").filter(F.col("_from").isNull() | (F.col("no") < F.col("_from")))
    f = _together(head).withColumnRenamed("l", "head")
    v = lambda key: _value(F.col("head"), key, r":\s+")
    per = F.slice("head", F.lit(_HEAD + 1), F.size("head"))
    f = f.withColumn("per", F.filter(per, lambda x: F.trim(x) != ""))
    n = _number(v("Channels exported")).cast("int")
    samples = v("Samples per channel")
    records = f.select(
        "record_id", F.col("record_id").alias("record_name"), n.alias("number_of_channels"), _number(v("Sample Rate")).alias("frequency"),
        F.trim(F.regexp_replace(samples, r"[0-9]{2}:[0-9]{2}:[0-9]{2}$", "")).try_cast("bigint").alias("samples"), v("Start time").alias("start_clock"),
        F.lit(SATURATION).alias("adc_saturation"), (F.floor(F.size("per") / _PER_CHANNEL) != n).alias("count_mismatch"),
    )
    c = f.select("record_id", "per", n.alias("n")).select("record_id", "per", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("i"))
    field = lambda k: F.trim(F.split(F.get("per", (F.col("i") - 1) * _PER_CHANNEL + k), r":\s+", 2)[1])
    span = _number(field(2))
    channels = c.select(
        "record_id", F.col("i").alias("number"), F.concat("record_id", F.lit(".dat")).alias("file_name"), F.lit(16).alias("storage_format"), F.lit(SATURATION).alias("adc_saturation"),
        _number(field(0)).cast("int").alias("vendor_number"), standard_label(field(1)).alias("label"), span.alias("additional_gain"), (F.lit(SATURATION) / F.when(span != 0, span)).alias("adc_gain"), F.lit(0).alias("adc_baseline"),
        F.lit("mV").alias("adc_units"), _number(field(3)).alias("low_pass"), _number(field(4)).alias("high_pass"), F.concat(F.lit("#"), field(6)).alias("color"), _number(field(7)).cast("int").alias("scale"),
    )
    return records, channels


def read_bard_signal(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(record_id, sample from 1, number, value) of the lines after [Data]; with ``n`` the first n samples."""
    lines = _lines(spark, path)
    rows = lines.join(_data_from(lines), "record_id").filter((F.col("no") > F.col("_from")) & (F.trim("line") != ""))
    rows = rows.withColumn("sample", (F.col("no") - F.col("_from")).cast("int"))
    if n is not None:
        rows = rows.filter(F.col("sample") <= n)
    return rows.select("record_id", "sample", F.posexplode(F.split("line", ",")).alias("p", "v")).select("record_id", "sample", (F.col("p") + 1).alias("number"), F.trim("v").try_cast("double").alias("value"))


def _labelled(signal: DataFrame, channels: DataFrame) -> DataFrame:
    return signal.join(channels.select("record_id", "number", "label"), ["record_id", "number"]).select("record_id", "sample", "label", "value")


def read_bard(spark: SparkSession, path: str, n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, channels, signal) of bard exports; signal long with labels, samples from 1, in counts."""
    records, channels = read_bard_header(spark, path)
    return records, channels, _labelled(read_bard_signal(spark, path, n), channels)


# ---- prucka ----------------------------------------------------------------------------------------------------------


def read_prucka_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, channels) of .inf files: ``key = value`` lines and a table of channels, which are taken by number."""
    f = _together(_lines(spark, path))
    f = f.withColumn("meta", F.filter("l", lambda x: F.size(F.split(x, r"\s*=\s*")) == 2))
    v = lambda key: _value(F.col("meta"), key, r"\s*=\s*")
    at = F.array_position(F.transform("l", lambda x: x.startswith("Channel Number")), True).cast("int")
    f = f.withColumn("table", F.when(at > 0, F.filter(F.slice("l", at + 1, F.size("l")), lambda x: F.trim(x) != "")))
    n = v("Number of Channel").try_cast("int")
    records = f.select(
        "record_id", F.col("record_id").alias("record_name"), n.alias("number_of_channels"), _number(v("Data Sampling Rate")).alias("frequency"),
        v("Points for Each Channel").try_cast("bigint").alias("samples"), start_time(v("Start Time")).alias("start_time"), F.lit(SATURATION).alias("adc_saturation"),
        F.when(F.col("table").isNull(), F.raise_error(F.lit("no channel table in the .inf file")).cast("boolean")).otherwise(F.size("table") != n).alias("count_mismatch"),
    )
    pair = lambda x: F.split(F.trim(x), r"\s+", 2)
    listed = F.transform(F.filter("table", lambda x: F.size(pair(x)) == 2), lambda x: F.struct(pair(x)[0].try_cast("int").alias("vendor_number"), F.regexp_replace(pair(x)[1], r"\s+", " ").alias("label")))
    channels = f.select("record_id", F.posexplode(F.array_sort(listed)).alias("p", "c")).select(
        "record_id", (F.col("p") + 1).alias("number"), F.concat("record_id", F.lit(".dat")).alias("file_name"), F.lit(16).alias("storage_format"), F.lit(SATURATION).alias("adc_saturation"), "c.vendor_number",
        standard_label(F.col("c.label")).alias("label"), F.lit(1.0).alias("additional_gain"), F.lit(float(SATURATION)).alias("adc_gain"), F.lit(0).alias("adc_baseline"), F.lit("mV").alias("adc_units"), F.lit("#000000").alias("color"),
    )
    return records, channels


def read_prucka_signal(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(record_id, sample from 1, number, value) of blank-separated text; every column is a channel."""
    rows = _lines(spark, path).filter(F.trim("line") != "").withColumn("sample", (F.col("no") + 1).cast("int"))
    if n is not None:
        rows = rows.filter(F.col("sample") <= n)
    cells = F.posexplode(F.split(F.trim("line"), r"\s+")).alias("p", "v")
    return rows.select("record_id", "sample", cells).select("record_id", "sample", (F.col("p") + 1).alias("number"), F.col("v").try_cast("double").alias("value"))


def read_prucka(spark: SparkSession, signal_path: str, header_path: str | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, channels, signal); by default the .inf file beside the signal file is the header."""
    header = header_path or posixpath.splitext(signal_path)[0] + ".inf"
    folder, _, name = header.rpartition("/")
    if "*" not in header and not files.exists(folder or ".", name):
        raise FileNotFoundError(f"header file not found: {header}")
    records, channels = read_prucka_header(spark, header)
    s = read_prucka_signal(spark, signal_path, n)
    known = channels.groupBy("record_id").agg(F.max("number").alias("_n"))
    odd = s.join(known, "record_id").filter(F.col("number") > F.col("_n"))
    named = _labelled(s, channels).unionByName(odd.select("record_id", "sample", F.concat(F.lit("CH"), F.col("number").cast("string")).alias("label"), "value"))
    return records, channels, named


# ---- muse ------------------------------------------------------------------------------------------------------------

_MUSE = """TestDemographics struct<AcquisitionDate:string,AcquisitionTime:string>,
PatientDemographics struct<PatientID:string,PatientAge:string,Gender:string,Race:string>,
Diagnosis struct<DiagnosisStatement:array<struct<StmtText:string,StmtFlag:string>>>,
Waveform array<struct<WaveformType:string,SampleBase:string,LeadData:array<struct<LeadID:string,LeadSampleCountTotal:string,LeadAmplitudeUnitsPerBit:string,WaveFormData:string>>>>"""
#: Leads in display order; the last four of the limb leads are made from I and II.
_TWELVE = ("I", "II", "III", "AVR", "AVL", "AVF", "V1", "V2", "V3", "V4", "V5", "V6")


def _int16(data: Column) -> Column:
    """Little-endian 16-bit integers of base64 text."""
    def value(h: Column) -> Column:
        v = F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
        return F.when(v > 32767, v - 65536).otherwise(v)

    def each(raw: Column) -> Column:
        n = F.floor(F.length(raw) / 2).cast("int")
        at = lambda i: let(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), value)  # noqa: E731, of bytes: no search from the start
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>"))

    return let(F.unbase64(F.regexp_replace(data, r"\s+", "")), each)


def read_muse(spark: SparkSession, path: str, root: str = "RestingECG") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, channels, signal) of XML files. The second waveform is the rhythm; III and the augmented leads are always
    made from I and II. Samples from 1, in the file's amplitude units. ``info`` of a record holds demographics and the
    cleaned diagnosis. The record is named after its file."""
    x = spark.read.format("xml").option("rowTag", root).schema(_MUSE).load(path)
    x = x.select("*", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("record_id")).withColumn("w", F.coalesce(F.get("Waveform", F.lit(1)), F.get("Waveform", F.lit(0))))
    dx = F.array_join(F.transform("Diagnosis.DiagnosisStatement", lambda s: F.concat_ws("", s["StmtText"], s["StmtFlag"])), ", ")
    dx = F.regexp_replace(F.regexp_replace(dx, "RESTING|ENDSLINE", ""), r"(?:,\s*)+,", ",")
    p = F.col("PatientDemographics")
    entries = [("mrn", p["PatientID"]), ("age", p["PatientAge"]), ("sex", p["Gender"]), ("race", p["Race"]), ("diagnosis", F.trim(F.regexp_replace(dx, r"^\s*,\s*|\s*,\s*$", "")))]
    info = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("values")) for k, v in entries]), lambda e: F.get(e["values"], F.lit(0)).isNotNull())
    when = start_time(F.concat_ws(" ", "TestDemographics.AcquisitionDate", "TestDemographics.AcquisitionTime"))
    records = x.select("record_id", F.col("record_id").alias("record_name"), F.lit(12).alias("number_of_channels"), F.col("w.SampleBase").try_cast("double").alias("frequency"),
        F.get("w.LeadData", F.lit(0))["LeadSampleCountTotal"].try_cast("bigint").alias("samples"), when.alias("start_time"), info.alias("info"))
    leads = x.select("record_id", F.explode("w.LeadData").alias("d")).select("record_id", F.upper("d.LeadID").alias("label"), F.posexplode(_int16(F.col("d.WaveFormData"))).alias("p", "c"), F.col("d.LeadAmplitudeUnitsPerBit").try_cast("double").alias("k"))
    measured = leads.select("record_id", (F.col("p") + 1).alias("sample"), "label", (F.col("c") * F.col("k")).alias("value")).filter(F.col("label").isin("I", "II", *_TWELVE[6:]))
    pair = measured.filter(F.col("label").isin("I", "II")).groupBy("record_id", "sample").agg(F.max(F.when(F.col("label") == "I", F.col("value"))).alias("i"), F.max(F.when(F.col("label") == "II", F.col("value"))).alias("ii"))
    made = {"III": "ii - i", "AVR": "-(i + ii) / 2", "AVL": "i - ii / 2", "AVF": "ii - i / 2"}
    derived = pair.select("record_id", "sample", F.explode(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*(F.expr(e) for e in made.values())))).alias("label", "value"))
    channels = records.select("record_id", F.posexplode(F.array(*map(F.lit, _TWELVE))).alias("p", "label")).select(
        "record_id", (F.col("p") + 1).alias("number"), F.concat("record_id", F.lit(".dat")).alias("file_name"), F.lit(16).alias("storage_format"), F.lit(200.0).alias("adc_gain"), F.lit(0).alias("adc_baseline"), F.lit("mV").alias("adc_units"), "label"
    )
    return records, channels, measured.unionByName(derived)
