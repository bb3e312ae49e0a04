"""Queries that write the tables to files of every kind and read them back, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe import api
from leadframe.functions.dims import ANNOTATIONS
from leadframe.functions.text import start_line, start_time
from leadframe.operators import annotations as ann_ops
from leadframe.operators.durable import scratch
from leadframe.plans import signals
from leadframe.plans.signals import _A, _COLUMN_LABEL, _DIM, _G, _LEADS
from leadframe.sources import files, vendors, wfdb
from leadframe.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Storage formats of the signal table's columns, by place.
FORMATS = (16, 24, 32, 16, 24, 32)
_GAIN, _BASE = 200.0, 12


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _signal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, channels, signal) of the signal table: a record's channels are the columns that it has any count in."""
    signal = signals.counts(spark, d)
    place = {v: (i + 1, f) for i, (v, f) in enumerate(zip(_COLUMN_LABEL.values(), FORMATS, strict=True))}
    order = F.create_map(*(F.lit(x) for k, (i, _) in place.items() for x in (k, i)))[F.col("label")]
    form = F.create_map(*(F.lit(x) for k, (_, f) in place.items() for x in (k, f)))[F.col("label")]
    channels = signal.select("record_id", "label").distinct().select(
        "record_id", order.alias("number"), F.lit(_GAIN).alias("adc_gain"), F.lit(_BASE).alias("adc_baseline"), F.lit("mV").alias("adc_units"), form.alias("storage_format"), "label"
    )
    records = signals.rates(spark, d).join(channels.select("record_id").distinct(), "record_id", "left_semi").select("record_id", F.col("record_id").alias("record_name"), "frequency")
    return records, channels, signal


def _written(spark: SparkSession, d: str) -> str:
    records, channels, signal = _signal(spark, d)
    folder = scratch(spark, "records")
    wfdb.write_records(signal, records, channels, folder)
    return folder


_FRAMES = (
    "s AS (SELECT DISTINCT * FROM signal_table), n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY sample) - 1 AS place FROM s WHERE coalesce(i, ii, v1, cs_1_2, rv_1_2, abl_d) IS NOT NULL), "
    "u AS (SELECT record_id, place, col, value FROM n UNPIVOT INCLUDE NULLS (value FOR col IN (i, ii, v1, cs_1_2, rv_1_2, abl_d))), "
    "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {f})" for (k, v), f in zip(_COLUMN_LABEL.items(), FORMATS, strict=True)) + ") t(col, label, fmt)), "
    "has AS (SELECT DISTINCT record_id, col FROM u WHERE value IS NOT NULL), "
    "c AS (SELECT record_id, place AS sample, label, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE greatest(least(round(value), pow(2, fmt - 1) - 1), -pow(2, fmt - 1)) END AS value FROM u JOIN has USING (record_id, col) JOIN m USING (col))"
)


@query(f"WITH {_FRAMES} SELECT record_id, CAST(sample AS INTEGER) AS sample, label, value FROM c")
def wfdb_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every count of the signal table, written in three storage formats and read back."""
    return wfdb.read_signal(spark, _written(spark, d))


_PHYSICAL = f"SELECT record_id, CAST(sample AS INTEGER) AS sample, label, round((value - {_BASE}) / {_GAIN}, 9) AS value FROM c"


@query(f"WITH {_FRAMES}, one AS (SELECT record_id, min_by(label, place) AS label FROM has JOIN (SELECT *, row_number() OVER () AS place FROM m) USING (col) GROUP BY record_id) {_PHYSICAL} WHERE label = 'II' AND sample >= 300 AND sample < 700 UNION ALL {_PHYSICAL} JOIN one USING (record_id, label) WHERE sample >= 300 AND sample < 700")
def wfdb_range_physical(spark: SparkSession, d: str) -> DataFrame:
    """Two channels, asked for by name in another case and by place, of a half-open range, in mV; the range reaches the reader."""
    s = wfdb.read_signal(spark, _written(spark, d), channels=["ii", 1], begin=300, units="physical", frames=1000)
    return s.filter("sample < 700").withColumn("value", F.round("value", 9))


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The header table as it is: typed, repeated and missing labels, gains of all conventions."""
    h = signals.channels(spark, d).filter(F.col("number").isNotNull())
    start = h.groupBy("record_id").agg(start_time(F.max("start_time")).alias("start_time"))
    r = signals.records(spark, d).select("record_id", "record_name", "frequency", F.col("samples").cast("bigint").alias("samples")).join(start, "record_id")
    return r, h.select("record_id", "number", "file_name", "storage_format", "adc_gain", "adc_baseline", "adc_units", "adc_resolution", "adc_zero", "initial_value", "checksum", "blocksize", "label")


def _headers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    folder = scratch(spark, "headers")
    wfdb.write_headers(*_typed(spark, d), folder)
    return wfdb.read_headers(spark, folder)


_HEADS = (
    "h AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM header_table WHERE number IS NOT NULL), r AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM records), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY number) AS place, CASE WHEN trim(coalesce(label, '')) = '' THEN 'CH' || row_number() OVER (PARTITION BY record_id ORDER BY number) ELSE replace(upper(trim(label)), '_', ' ') END AS l FROM h JOIN (SELECT record_id FROM r) USING (record_id)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY record_id, l ORDER BY place) - 1 AS again FROM b)"
)


@query(
    f"WITH {_HEADS} SELECT record_id, CAST(place AS INTEGER) AS number, CASE WHEN again > 0 THEN l || '_' || again ELSE l END AS label, storage_format, CASE WHEN isnan(adc_gain) THEN NULL ELSE coalesce(adc_gain, 200) END AS adc_gain, adc_baseline, "
    "coalesce(nullif(regexp_replace(trim(adc_units), '\\s+', '_', 'g'), ''), 'mV') AS adc_units, coalesce(adc_resolution, 12) AS adc_resolution, coalesce(adc_zero, 0) AS adc_zero, coalesce(checksum, 0) AS checksum FROM k"
)
def wfdb_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels of header files: blank labels are CH<number>, repeated ones made unique; numbers come back exactly."""
    c = _headers(spark, d)[1]
    return c.select("record_id", "number", "label", "storage_format", F.when(~F.isnan("adc_gain"), F.col("adc_gain")).alias("adc_gain"), "adc_baseline", "adc_units", "adc_resolution", "adc_zero", "checksum")


@query(
    f"WITH {_HEADS}, t AS (SELECT record_id, max(start_time) AS t, count(*) AS n FROM h GROUP BY ALL), x AS (SELECT record_id, n, trim(regexp_replace(t, '[.]\\d+ ', ' ')) AS t FROM t) "
    "SELECT record_id, record_name, CAST(n AS INTEGER) AS number_of_channels, coalesce(frequency, 250) AS frequency, CAST(coalesce(samples, 0) AS BIGINT) AS samples, "
    "strftime(coalesce(try_strptime(t, '%H:%M:%S %d/%m/%Y'), try_strptime(t, '%m/%d/%Y %I:%M:%S %p'), CASE WHEN regexp_full_match(t, '\\d\\d-\\d\\d-\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(t, '%m-%d-%Y %H:%M:%S') END), '%H:%M:%S %d/%m/%Y') AS start_line FROM r JOIN x USING (record_id)"
)
def wfdb_records(spark: SparkSession, d: str) -> DataFrame:
    """Record lines of header files."""
    r = _headers(spark, d)[0]
    return r.select("record_id", "record_name", "number_of_channels", "frequency", "samples", start_line(F.col("start_time")).alias("start_line"))


_CODES = ", ".join("'" + s.replace("'", "''") + "'" for c, s, _, _ in ANNOTATIONS if c)
_MARKS = f"{_A}, m AS (SELECT *, row_number() OVER (PARTITION BY record_id, annotator ORDER BY sample, ann_id) - 1 AS row_no FROM a WHERE sample >= 0 AND type IN ({_CODES}))"


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Annotations that a file can hold: with a sample and a known type; in order of sample and key."""
    a = signals.annotations(spark, d).filter((F.col("sample") >= 0) & F.col("type").isin(*(s for c, s, _, _ in ANNOTATIONS if c)))
    return a.withColumnRenamed("ann_id", "row_no")


@query(
    f"WITH {_MARKS}, {_DIM} SELECT record_id, annotator, CAST(row_no AS INTEGER) AS row_no, sample, type, coalesce(TRY_CAST(subtype AS INTEGER), 0) AS subtype, coalesce(channel, 0) AS channel, coalesce(number, 0) AS number, mnemonic, label_store "
    "FROM m JOIN dim ON type = symbol"
)
def annotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All annotations written to one file per record and annotator, read back in their order, and decoded with it."""
    marks, folder = _marks(spark, d), scratch(spark, "annotations")
    parts = []
    for annotator in ("atr", "qrs", "ecgpuwave"):
        wfdb.write_annotations(marks.filter(F.col("annotator") == annotator), folder, annotator)
        parts.append(wfdb.read_annotations(spark, folder, annotator))
    a = api.combine(*parts)
    return ann_ops.decoded(a).select("record_id", "annotator", "row_no", "sample", "type", "subtype", "channel", "number", "mnemonic", "label_store")


# ---- vendor exports --------------------------------------------------------------------------------------------------


def _wide(spark: SparkSession, d: str) -> tuple[list[str], DataFrame]:
    """Rows of the signal table in order of sample, numbered from 1, with whole finite counts (missing ones 0)."""
    s = table(spark, d, "signal_table").distinct()
    names = list(_COLUMN_LABEL)
    whole = lambda c: F.when(F.abs(c) < 9e8, F.round(c)).otherwise(0).cast("int").alias(c)
    return names, s.select("record_id", "sample", *(whole(c) for c in names))


_ROUNDED = ", ".join(f"CASE WHEN isfinite({c}) AND abs({c}) < 9e8 THEN round({c}) ELSE 0 END AS {c}" for c in _COLUMN_LABEL)
_EXPORT = (
    f"s AS (SELECT DISTINCT * FROM signal_table), n AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY sample) AS place, {_ROUNDED} FROM s), "
    "u AS (UNPIVOT n ON i, ii, v1, cs_1_2, rv_1_2, abl_d INTO NAME col VALUE value), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_COLUMN_LABEL.items(), 1)) + ") t(col, label, number))"
)


def _body(rows: DataFrame, cells: Column) -> DataFrame:
    """(record_id, body, n): the lines of each record, in order of sample."""
    a = rows.withColumn("_line", cells).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("sample", "_line"))).alias("_l"), F.count(F.lit(1)).alias("n"))
    return a.select("record_id", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("body"), "n")


def _rate_text(form: str) -> Column:
    return F.format_string(form, F.col("frequency").cast("int"))


@query(f"WITH {_EXPORT} SELECT record_id, CAST(place AS INTEGER) AS sample, label, value FROM u JOIN m USING (col) UNION ALL SELECT 'rate ' || record_id, 0, '', max(frequency) FROM records WHERE record_id IN (SELECT record_id FROM s) GROUP BY record_id UNION ALL SELECT 'gain ' || record_id, number, label, 6553.6 FROM (SELECT DISTINCT record_id FROM s), m")
def bard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The signal table as comma-separated exports with their header; counts, rates and gains come back."""
    names, wide = _wide(spark, d)
    body = _body(wide, F.concat_ws(",", *names)).join(signals.rates(spark, d), "record_id")
    head = [F.lit("[Header]"), F.lit("File Type: 1"), F.lit("Version: 1"), F.format_string("Channels exported: %d", F.lit(len(names))), F.format_string("Samples per channel: %d", "n"), F.lit("Start time: 10:11:12"), F.lit("End time: 10:12:13"),
            F.lit("Ch. Info. Pointer: 320"), F.lit("Stamp Data: F"), F.lit("Mux format: 0"), F.lit("Mux Block Size: 0"), F.lit("Data Format 1"), _rate_text("Sample Rate: %dHz")]
    for i, label in enumerate(_COLUMN_LABEL.values(), 1):
        head += [F.lit(x) for x in (f"Channel #: {i}", f"Label: {label}", "Range: 5mv", "Low: 30Hz", "High: 250Hz", "Sample rate: 1000Hz", "Color: 0000FF", "Scale: -6")]
    text = F.concat_ws("\n", *head, F.lit("[Data]"), "body")
    folder = scratch(spark, "bard")
    files.write_files(body.select(F.concat("record_id", F.lit(".txt")).alias("name"), text.alias("content")), folder)
    records, channels, signal = vendors.read_bard(spark, folder)
    rates = records.select(F.concat(F.lit("rate "), "record_id").alias("record_id"), F.lit(0).alias("sample"), F.lit("").alias("label"), F.col("frequency").alias("value"))
    gains = channels.select(F.concat(F.lit("gain "), "record_id").alias("record_id"), F.col("number").alias("sample"), "label", F.col("adc_gain").alias("value"))
    return signal.select("record_id", "sample", "label", "value").unionByName(rates).unionByName(gains)


@query(f"WITH {_EXPORT} SELECT record_id, CAST(place AS INTEGER) AS sample, label, value FROM u JOIN m USING (col) WHERE place <= 500 UNION ALL SELECT 'rate ' || record_id, 0, '', max(frequency) FROM records WHERE record_id IN (SELECT record_id FROM s) GROUP BY record_id")
def prucka_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The signal table as pairs of blank-separated texts and headers whose channels are listed backwards; the first 500 samples come back."""
    names, wide = _wide(spark, d)
    body = _body(wide, F.concat_ws(" ", *names)).join(signals.rates(spark, d), "record_id")
    head = [F.lit("Patient Name = test"), F.format_string("Number of Channel = %d", F.lit(len(names))), F.format_string("Points for Each Channel = %d", "n"), _rate_text("Data Sampling Rate = %d points/second"), F.lit("Start Time = 7/26/2024 10:02:58 AM"), F.lit("Channel Number  Channel Label")]
    head += [F.lit(f"{10 * i + 1}     {label}") for i, label in reversed(list(enumerate(_COLUMN_LABEL.values(), 1)))]
    folder = scratch(spark, "prucka")
    texts = body.select(F.explode(F.array(F.struct(F.concat("record_id", F.lit(".inf")).alias("name"), F.concat_ws("\n", *head).alias("content")), F.struct(F.concat("record_id", F.lit(".txt")).alias("name"), F.col("body").alias("content")))).alias("f"))
    files.write_files(texts.select("f.name", "f.content"), folder)
    records, _, signal = vendors.read_prucka(spark, f"{folder}/*.txt", f"{folder}/*.inf", 500)
    rates = records.select(F.concat(F.lit("rate "), "record_id").alias("record_id"), F.lit(0).alias("sample"), F.lit("").alias("label"), F.col("frequency").alias("value"))
    return signal.select("record_id", "sample", "label", "value").unionByName(rates)


_HELD = lambda c: f"greatest(least({c}, 32767), -32768) * 4.88"
_MUSE_SQL = " UNION ALL ".join(
    f"SELECT record_id, CAST(place AS INTEGER) AS sample, '{label}' AS label, round({e}, 6) AS value FROM h" for label, e in (("I", "i"), ("II", "ii"), ("V1", "v1"), ("III", "ii - i"), ("AVR", "-(i + ii) / 2"), ("AVL", "i - ii / 2"), ("AVF", "ii - i / 2"))
)


@query(f"WITH {_EXPORT}, h AS (SELECT record_id, place, {_HELD('i')} AS i, {_HELD('ii')} AS ii, {_HELD('v1')} AS v1 FROM n) {_MUSE_SQL}")
def muse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Leads I, II and V1 as XML with 16-bit integers in base64; they and the leads made of them come back."""
    _, wide = _wide(spark, d)

    def word(c: str) -> Column:
        held = F.greatest(F.least(F.col(c), F.lit(32767)), F.lit(-32768))
        h = F.lpad(F.hex(F.pmod(held, F.lit(65536))), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    leads = {"I": "i", "II": "ii", "V1": "v1"}
    rows = wide.select("record_id", "sample", *(word(c).alias(f"w_{c}") for c in leads.values()))
    one = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("sample", *(f"w_{c}" for c in leads.values())))).alias("l"), F.count(F.lit(1)).alias("n"))
    data = lambda c: F.base64(F.unhex(F.array_join(F.transform("l", lambda x: x[f"w_{c}"]), "")))
    lead = [
        F.concat(F.lit(f"<LeadData><LeadID>{k}</LeadID><LeadSampleCountTotal>"), F.col("n").cast("string"), F.lit("</LeadSampleCountTotal><LeadAmplitudeUnitsPerBit>4.88</LeadAmplitudeUnitsPerBit><WaveFormData>"), data(c), F.lit("</WaveFormData></LeadData>"))
        for k, c in leads.items()
    ]
    text = F.concat(F.lit("<RestingECG><Waveform><SampleBase>1</SampleBase></Waveform><Waveform><SampleBase>500</SampleBase>"), *lead, F.lit("</Waveform></RestingECG>"))
    folder = scratch(spark, "muse")
    files.write_files(one.select(F.concat("record_id", F.lit(".xml")).alias("name"), text.alias("content")), folder)
    return vendors.read_muse(spark, folder)[2].select("record_id", "sample", "label", F.round("value", 6).alias("value"))


# ---- the facade ------------------------------------------------------------------------------------------------------


def _recording(spark: SparkSession, d: str) -> api.Recording:
    """The tables as one recording."""
    s = signals.readings(spark, d).withColumnRenamed("mv", "value")
    r = signals.records(spark, d)
    return api.recording(s, r, signals.channels(spark, d), signals.annotations(spark, d, "ecgpuwave"))


_WINDOWS = signals._windows_sql(True, True)


@query(
    f"WITH {_WINDOWS}, {_G}, i AS (SELECT record_id, window_id, onset, \"offset\" FROM w WHERE window_id IN (1, 3)) SELECT g.record_id, window_id, count(*) AS n, min(g.sample) AS first, max(g.sample) AS last, round(max(mv) - min(mv), 6) AS span "
    'FROM g JOIN i ON g.record_id = i.record_id AND g.sample BETWEEN i.onset AND i."offset" GROUP BY ALL'
)
def windows_selected_and_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Two windows of each record, and a function of the user's over each."""
    w = api.window(_recording(spark, d), window_method="rhythm", onset_criteria=signals.ONSET, offset_criteria=signals.OFFSET, reference_criteria=signals.REFERENCE)
    w = api.windowed(w.table, w.source).select([1, 3])

    def facts(p):
        import pandas as pd

        return pd.DataFrame({"record_id": p["record_id"][:1], "window_id": p["window_id"][:1], "n": [len(p)], "first": [p["sample"].min()], "last": [p["sample"].max()], "span": [round(p["value"].max() - p["value"].min(), 6)]})

    return w.map(facts, "record_id string, window_id int, n bigint, first int, last int, span double")


@query(signals._normalized_sql("linear", 50, False, -1).replace(" AS mv FROM z", " AS value FROM z"))
def windows_standardized(spark: SparkSession, d: str) -> DataFrame:
    """Windows of one length, aligned at their beat with the sign users know; windows without the beat stay as they are."""
    w = api.window(_recording(spark, d), onset_criteria=signals.ONSET, offset_criteria=signals.OFFSET, reference_criteria=signals.REFERENCE)
    return api.standardize_windows(w, 50, align_feature="N", preserve_amplitude=False).withColumn("value", F.round("value", 6))


@query(f"WITH {_A}, {_G} SELECT record_id, sample, label, round(mv, 6) AS value, NULL AS type FROM g UNION ALL SELECT record_id, sample, NULL, NULL, type FROM a")
def tables_combined(spark: SparkSession, d: str) -> DataFrame:
    """Readings and marks under one schema."""
    s = signals.readings(spark, d).select("record_id", "sample", "label", F.round("mv", 6).alias("value"))
    return api.combine(s, signals.annotations(spark, d).select("record_id", "sample", "type"))


@query(
    f"WITH {_LEADS}, o AS (SELECT label, row_number() OVER (ORDER BY label_id) AS number FROM lead_dim) SELECT CAST(number AS INTEGER) AS number, o.label, 16 AS storage_format, 200.0::DOUBLE AS adc_gain, 0 AS adc_baseline, 'mV' AS adc_units, 12 AS adc_resolution, "
    "'#000000' AS color, split_part(CASE WHEN lead_group = 'ECG' THEN 'ECG' ELSE o.label END, ' ', 1) AS source, CASE WHEN lead_group = 'ECG' THEN o.label ELSE split_part(o.label, ' ', 2) END AS lead, ord FROM o JOIN leads ON o.label = leads.label"
)
def constructed_header(spark: SparkSession, d: str) -> DataFrame:
    """A header made from the list of leads, with all defaults."""
    labels = [r["label"].lower().replace(" ", "_") for r in table(spark, d, "lead_dim", "label_id", "label").orderBy("label_id").collect()]
    _, c = api.header_table(spark, labels, "list")
    return c.select("number", "label", "storage_format", "adc_gain", "adc_baseline", "adc_units", "adc_resolution", "color", "source", "lead", "ord")


@query(
    "WITH t AS (SELECT table_name AS name, list(column_name) AS c FROM information_schema.columns WHERE table_name IN ('ggm', 'annotation_table', 'header_table', 'records', 'signal_table') GROUP BY table_name) "
    "SELECT name, list_has_all(c, ['record_id', 'sample', 'label']) AS is_signal, list_has_all(c, ['record_id', 'time', 'sample', 'type', 'subtype', 'channel', 'number']) AS is_annotation, "
    "list_has_all(c, ['record_id', 'number', 'label', 'storage_format', 'adc_gain']) AS is_header FROM t"
)
def table_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What kind of table each one is."""
    rows = [(n, api.is_signal_table(t), api.is_annotation_table(t), api.is_header_table(t)) for n in ("ggm", "annotation_table", "header_table", "records", "signal_table") for t in [table(spark, d, n)]]
    return spark.createDataFrame(rows, "name string, is_signal boolean, is_annotation boolean, is_header boolean")


@query(
    f"WITH {_G}, c AS (SELECT DISTINCT record_id, label FROM header_table WHERE label IS NOT NULL) SELECT record_id, sample, " + ", ".join(f"round(max(mv) FILTER (label = '{x}'), 6) AS \"{x}\"" for x in ("I", "II", "CS 1-2"))
    + " FROM g WHERE label IN ('I', 'II', 'CS 1-2') GROUP BY record_id, sample"
)
def extracted_signal(spark: SparkSession, d: str) -> DataFrame:
    """Three channels of all records as wide rows."""
    rec = _recording(spark, d)
    three = ["I", "II", "CS 1-2"]
    chosen = api.recording(rec.signal.filter(F.col("label").isin(*three)), rec.records, rec.channels.filter(F.col("label").isin(*three)))
    w = api.extract_signal(chosen)
    return w.select("record_id", "sample", *(F.round(F.col(f"`{x}`"), 6).alias(x) for x in three))
