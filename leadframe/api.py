"""The whole surface in one place: a recording of DataFrames, and functions by the names users know."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.functions import dims, dsp
from leadframe.functions.text import elapsed, elapsed_short, standard_label
from leadframe.operators import annotations as _ann
from leadframe.operators import channels as _ch
from leadframe.operators import rhythm as _rhythm
from leadframe.operators import waveforms as _wave
from leadframe.sources import files, vendors, wfdb

SIGNAL = "record_id string, sample int, label string, value double"
ANNOTATION = "record_id string, annotator string, time string, sample int, type string, subtype string, channel int, number int"


@dataclass(frozen=True)
class Recording:
    """Signal (long), channels, records and annotations of one or many records, keyed by ``record_id``."""

    signal: DataFrame
    channels: DataFrame
    records: DataFrame
    annotations: DataFrame
    twelve_lead: bool = False

    def describe(self) -> DataFrame:
        """One row per record: rate, duration, channels, annotators."""
        n = self.channels.groupBy("record_id").agg(F.count(F.lit(1)).alias("channels"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
        a = self.annotations.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("annotator")), ", ").alias("annotators"))
        r = self.records.join(n, "record_id", "left").join(a, "record_id", "left")
        return r.select("record_id", "frequency", (F.col("samples") / F.col("frequency")).alias("duration_s"), "channels", "labels", "annotators")


@dataclass(frozen=True)
class Windows:
    """Windows of a recording with the way they were made; slices come from the recording when asked for."""

    table: DataFrame
    source: Recording
    method: str = "rhythm"

    def signal(self) -> DataFrame:
        return _ann.window_signal(self.source.signal, self.table)

    def annotations(self, adjust: bool = True) -> DataFrame:
        return _ann.window_annotations(self.source.annotations.filter("sample is not null"), self.table, adjust=adjust)

    def map_arrow(self, work: Callable, schema: str) -> DataFrame:
        """``work`` on the Arrow table of each window."""
        return self.signal().groupBy("record_id", "window_id").applyInArrow(work, schema)

    def select(self, ids: Sequence[int]) -> Windows:
        return replace(self, table=self.table.filter(F.col("window_id").isin(*ids)))

    def concat(self, *others: Windows) -> Windows:
        if not all(isinstance(o, Windows) for o in others):
            raise TypeError("only windows can be joined to windows")
        return replace(self, table=_ann.concat_windows(self.table, *(o.table for o in others)))

    def map(self, work: Callable, schema: str) -> DataFrame:
        """``work`` on the pandas rows of each window."""
        return self.signal().groupBy("record_id", "window_id").applyInPandas(work, schema)


def _has(df: DataFrame, columns: Sequence[str]) -> bool:
    return isinstance(df, DataFrame) and set(columns) <= set(df.columns)


def is_signal_table(x: object) -> bool:
    return _has(x, ["record_id", "sample", "label"])


def is_annotation_table(x: object) -> bool:
    return _has(x, ["record_id", "time", "sample", "type", "subtype", "channel", "number"])


def is_header_table(x: object) -> bool:
    return _has(x, ["record_id", "number", "label", "storage_format", "adc_gain"])


def is_recording(x: object) -> bool:
    return isinstance(x, Recording)


def is_ecg(x: object) -> bool:
    return isinstance(x, Recording) and x.twelve_lead


def is_windowed(x: object) -> bool:
    return isinstance(x, Windows)


def windowed(table: DataFrame, source: Recording, method: str = "rhythm") -> Windows:
    """Windows from a table of (record_id, window_id, onset, offset) over a recording."""
    if not isinstance(source, Recording):
        raise TypeError("windows need the recording they come from")
    if not _has(table, ["record_id", "window_id", "onset", "offset"]):
        raise TypeError("windows need record_id, window_id, onset and offset")
    return Windows(table, source, method)


# ---- constructors ----------------------------------------------------------------------------------------------------


def signal_table(spark: SparkSession, columns: Mapping[str, Sequence[float]] | Sequence[tuple[str, Sequence[float]]] | None = None, record_id: str = "record") -> DataFrame:
    """Long signal from columns of numbers (a mapping, or pairs whose names may repeat: ECG, ECG_1, ...); without a ``sample``
    column samples count from 1."""
    pairs = list(columns.items() if isinstance(columns, Mapping) else columns or ())
    given, cols = [k for k, _ in pairs], {}
    for k, v in pairs:
        name, i = k, 0
        while name in cols or (i and name in given):
            i += 1
            name = f"{k}_{i}"
        cols[name] = v
    if not cols:
        return spark.createDataFrame([], SIGNAL)
    n = len(next(iter(cols.values())))
    if any(len(v) != n for v in cols.values()):
        raise ValueError("columns differ in length")
    samples = list(cols.pop("sample", range(1, n + 1)))
    rows = [(record_id, int(s), k, None if v is None else float(v)) for k, vs in cols.items() for s, v in zip(samples, vs, strict=True)]
    return spark.createDataFrame(rows, SIGNAL)


def annotation_table(spark: SparkSession, rows: Sequence[Mapping[str, object]] = (), annotator: str = "", record_id: str = "record", frequency: float | None = None) -> DataFrame:
    """Annotations with what is missing filled in: blank texts, zero numbers, time from the rate."""
    data = [(record_id, annotator, r.get("time"), r.get("sample"), r.get("type"), None if r.get("subtype") is None else str(r["subtype"]), r.get("channel"), r.get("number")) for r in rows]
    df = spark.createDataFrame(data, ANNOTATION)
    return _ann.filled(df.withColumn("_f", F.lit(frequency).cast("double")), "_f").drop("_f") if frequency else _ann.filled(df)


def header_table(spark: SparkSession, labels: Sequence[str], record_name: str = "record", frequency: float = 250.0, samples: int | None = None, start_time: object = None,
                 storage_format: int | Sequence[int] = 16, adc_gain: float | Sequence[float] = 200.0, adc_baseline: int | Sequence[int] | None = None, adc_units: str | Sequence[str] = "mV",
                 adc_saturation: int | None = None, additional_gain: float | Sequence[float] = 1.0, file_name: str | None = None, color: str | Sequence[str] = "#000000",
                 number_of_channels: int | None = None, adc_resolution: int | Sequence[int] = 12, adc_zero: int | Sequence[int] = 0, initial_value: int | Sequence[int] | None = None,
                 checksum: int | Sequence[int] = 0, blocksize: int | Sequence[int] = 0, low_pass: int | Sequence[int] | None = None, high_pass: int | Sequence[int] | None = None,
                 scale: int | Sequence[int] | None = None, info_strings: Mapping[str, Sequence[object]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, channels) with the defaults of the format; labels in standard form with source, lead and display order.

    What belongs to channels may be one value or one per channel. Baseline and initial value default to the zero; with a
    saturation the gain is the saturation over ``additional_gain``. A stated ``number_of_channels`` above 0 is kept.
    """
    n = len(labels)
    each = lambda v: list(v) if isinstance(v, (list, tuple)) else [v] * n
    info = [(k, [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]) for k, v in (info_strings or {}).items()]
    if any(not k for k, _ in info):
        raise ValueError("info strings must be named")
    records = spark.createDataFrame([(record_name, record_name, number_of_channels or n, float(frequency), samples, start_time, adc_saturation, info)],
        "record_id string, record_name string, number_of_channels int, frequency double, samples bigint, start_time timestamp_ntz, adc_saturation int, info array<struct<key:string,values:array<string>>>")
    zero = each(adc_zero)
    more = each(additional_gain)
    gain = [float(adc_saturation) / a for a in more] if adc_saturation else [float(g) for g in each(adc_gain)]
    columns = {
        "number int": range(1, n + 1), "file_name string": each(file_name or f"{record_name}.dat"), "storage_format int": each(storage_format), "adc_gain double": gain,
        "adc_baseline int": zero if adc_baseline is None else each(adc_baseline), "adc_units string": each(adc_units), "adc_resolution int": each(adc_resolution), "adc_zero int": zero,
        "initial_value int": zero if initial_value is None else each(initial_value), "checksum int": each(checksum), "blocksize int": each(blocksize), "label string": labels,
        "additional_gain double": [float(a) for a in more], "low_pass int": each(low_pass), "high_pass int": each(high_pass), "color string": each(color), "scale int": each(scale),
    }
    channels = spark.createDataFrame([(record_name, *r) for r in zip(*columns.values(), strict=True)], ", ".join(["record_id string", *columns]))
    return records, _ch.with_sources(channels)


def recording(signal: DataFrame, records: DataFrame, channels: DataFrame, annotations: DataFrame | None = None) -> Recording:
    """A recording; annotations may be missing."""
    spark = signal.sparkSession
    return Recording(signal, channels, records, annotations if annotations is not None else annotation_table(spark))


def ecg(signal: DataFrame, records: DataFrame, channels: DataFrame, annotations: DataFrame | None = None) -> Recording:
    """A recording taken as a 12-lead one; :func:`ecg_warnings` tells which records are not."""
    return as_ecg(recording(signal, records, channels, annotations))


def as_ecg(x: Recording) -> Recording:
    if not isinstance(x, Recording):
        raise TypeError("only a recording can be taken as a 12-lead recording")
    return replace(x, twelve_lead=True)


def ecg_warnings(x: Recording) -> DataFrame:
    return _ch.ecg_warnings(x.channels)


# ---- files -----------------------------------------------------------------------------------------------------------


def read_header(spark: SparkSession, record: str, record_dir: str = ".") -> tuple[DataFrame, DataFrame]:
    """(records, channels) of one record; ``record_dir`` may be a path or a URI, here and in all readers and writers."""
    if not files.exists(record_dir, f"{record}.hea"):
        raise FileNotFoundError(f"{record} not found in {record_dir}")
    return wfdb.read_headers(spark, f"{record_dir.rstrip('/')}/{record}.hea")


def _samples(spark: SparkSession, record: str, record_dir: str, begin: float, end: float | None, interval: float | None) -> tuple[int, int | None]:
    if not begin and end is None and interval is None:
        return 0, None
    rate = read_header(spark, record, record_dir)[0].first()["frequency"]
    first = round(begin * rate)
    if interval is not None:
        return first, first + round(interval * rate)
    return first, None if end is None else round(end * rate)


def read_signal(spark: SparkSession, record: str, record_dir: str = ".", begin: float = 0.0, end: float | None = None, interval: float | None = None, units: str = "digital", channels: Sequence[str | int] = ()) -> DataFrame:
    """Signal from ``begin`` to before ``end`` seconds; an interval goes before an end. Unknown channels are refused."""
    first, last = _samples(spark, record, record_dir, begin, end, interval)
    return wfdb.read_signal(spark, record_dir, [record], channels, first, last, units)


def read_annotation(spark: SparkSession, record: str, annotator: str, record_dir: str = ".", begin: float = 0.0, end: float | None = None) -> DataFrame:
    """Annotations from floor(begin) to ceiling(end) of the seconds' samples, both included."""
    a = wfdb.read_annotations(spark, record_dir, annotator, [record]).join(read_header(spark, record, record_dir)[0].select("record_id", "frequency"), "record_id")
    a = _ann.within_time(a, begin, end) if begin or end is not None else a
    return a.select("record_id", "annotator", elapsed(F.col("sample"), F.col("frequency")).alias("time"), "sample", "type", F.col("subtype").cast("string").alias("subtype"), "channel", "number", "row_no")


def read_wfdb(spark: SparkSession, record: str, record_dir: str = ".", annotator: str | None = None, begin: float = 0.0, end: float | None = None, interval: float | None = None, units: str = "digital", channels: Sequence[str | int] = ()) -> Recording:
    records, chans = read_header(spark, record, record_dir)
    a = read_annotation(spark, record, annotator, record_dir, begin, end) if annotator else None
    return recording(read_signal(spark, record, record_dir, begin, end, interval, units, channels), records, _ch.with_sources(chans, standard=False), a)


def write_wfdb(data: Recording | DataFrame, record: str | None = None, record_dir: str = ".", header: tuple[DataFrame, DataFrame] | None = None,
               info_strings: Mapping[str, Sequence[object]] | None = None, units: str = "digital") -> DataFrame:
    """Write records; returns (record_id, path, frames).

    ``data`` is a recording, whose own header counts, or a wide signal table of one record (``sample`` and one column per
    channel) with ``header`` (records, channels). Columns go to the channels of their label; if a label has no column they go
    by place, provided that there are as many columns as channels; otherwise it is an error. ``record`` renames a single
    record. ``info_strings`` are added to those of the header.
    """
    if isinstance(data, Recording):
        if header is not None:
            warnings.warn("the header given is not used: a recording has its own", stacklevel=2)
        signal, records, channels = data.signal, data.records, data.channels
    else:
        if header is None:
            raise ValueError("a header is needed for data that is no recording")
        records, channels = header
        signal, channels = _aligned(data, records, channels)
    if info_strings:
        if any(not k for k in info_strings):
            raise ValueError("info strings must be named")
        more = F.array(*(F.struct(F.lit(k).alias("key"), F.array(*(F.lit(str(x)) for x in (v if isinstance(v, (list, tuple)) else [v]))).alias("values")) for k, v in info_strings.items()))
        records = records.withColumn("info", F.concat("info", more) if "info" in records.columns else more)
    if record is not None:
        if len(records.select("record_id").distinct().take(2)) > 1:
            raise ValueError("only a single record can be given a name")
        signal, channels = (x.withColumn("record_id", F.lit(record)) for x in (signal, channels))
        records = records.withColumn("record_id", F.lit(record)).withColumn("record_name", F.lit(record))
    return wfdb.write_records(signal, records, channels, record_dir, units)


def _aligned(wide: DataFrame, records: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long signal and channels under the same labels, from columns by label or by place."""
    columns = [c for c in wide.columns if c not in ("sample", "record_id")]
    if not columns:
        raise ValueError("a signal needs at least one channel")
    if "sample" not in wide.columns:
        raise ValueError("a signal needs samples")
    rows = channels.select("number", "label").orderBy("number").collect()
    stated = [r["label"] or "" for r in rows]
    labels = stated if any(stated) else [f"CH{r['number']}" for r in rows]
    if set(labels) <= set(columns):
        picked = labels
    elif len(columns) == len(labels):
        picked = columns
    else:
        raise ValueError("signal columns do not align with the header's labels")
    names = dict(zip((r["number"] for r in rows), wfdb.own_labels(labels), strict=True))
    key = records.select("record_id").first()[0]
    cells = F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"`{c}`").cast("double").alias("value")) for n, c in zip(names.values(), picked, strict=True)))
    long = wide.select(F.lit(key).alias("record_id"), "sample", F.inline(cells))
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("number")]
    return long, channels.withColumn("label", label)


def write_annotation(data: DataFrame, annotator: str, record: str | None = None, record_dir: str = ".") -> DataFrame:
    """Write annotations, one file per record; ``record`` renames a single one. Returns (record_id, path, marks)."""
    missing = {"sample", "type", "subtype", "channel", "number"} - set(data.columns)
    if missing:
        raise ValueError(f"annotations lack {', '.join(sorted(missing))}")
    return wfdb.write_annotations(data if record is None else data.withColumn("record_id", F.lit(record)), record_dir, annotator)


def combine(*tables: DataFrame) -> DataFrame:
    """Rows of several tables under one schema: columns by name, missing ones null, numbers in the widest of their types.
    Types that do not go together are an error; so are recordings, whose parts are combined one by one."""
    if not tables or not all(isinstance(t, DataFrame) for t in tables):
        raise TypeError("only tables can be combined")
    kinds: dict[str, str] = {}
    for t in tables:
        for c, k in t.dtypes:
            have = kinds.get(c, k)
            if have != k and not {have, k} <= set(_NUMBERS):
                raise TypeError(f"{c} is {have} in one table and {k} in another")
            kinds[c] = have if have == k else max(have, k, key=_NUMBERS.index)
    each = [t.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in t.columns)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


#: Kinds of numbers, each wider than the ones before it.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _vendor(parts: tuple[DataFrame, DataFrame, DataFrame]) -> Recording:
    records, channels, signal = parts
    return recording(signal, records, _ch.with_sources(channels))


def read_bard(spark: SparkSession, path: str, n: int | None = None) -> Recording:
    return _vendor(vendors.read_bard(spark, path, n))


def read_prucka(spark: SparkSession, signal_file: str, header_file: str | None = None, n: int | None = None) -> Recording:
    return _vendor(vendors.read_prucka(spark, signal_file, header_file, n))


def read_muse(spark: SparkSession, path: str) -> Recording:
    return as_ecg(_vendor(vendors.read_muse(spark, path)))


read_bard_header, read_bard_signal = vendors.read_bard_header, vendors.read_bard_signal
read_prucka_header, read_prucka_signal = vendors.read_prucka_header, vendors.read_prucka_signal


def extract_signal(x: Recording, data_format: str = "data_frame") -> DataFrame:
    """Wide rows with the sample ("data_frame"), without it ("matrix"), or one array per channel ("array")."""
    if not isinstance(x, Recording):
        raise TypeError("a recording is needed")
    if data_format == "array":
        return _ch.signal_arrays(x.signal)
    labels = [r["label"] for r in x.channels.select("label", "number").groupBy("label").agg(F.min("number").alias("n")).orderBy("n").collect()]
    wide = _ch.wide_signal(x.signal, labels).orderBy("record_id", "sample")
    return wide if data_format == "data_frame" else wide.drop("sample")


#: Where external programs of the format are looked for; nothing here needs them.
_options: dict[str, str | None] = {"wfdb_path": None}


def set_wfdb_path(path: str | None) -> None:
    _options["wfdb_path"] = path


def find_wfdb_software() -> str | None:
    """The folder set before, else that of a program on the search path, else None."""
    import os
    import shutil

    hit = shutil.which("wfdb-config")
    return _options["wfdb_path"] or (os.path.dirname(hit) if hit else None)


def find_wfdb_command(app: str, path: str | None = None) -> str:
    import os

    folder = path or find_wfdb_software()
    return os.path.join(folder, app) if folder else app


# ---- annotations and windows -----------------------------------------------------------------------------------------


def wfdb_annotation_labels(spark: SparkSession, symbol: Sequence[str] | None = None, label_store: Sequence[int] | None = None) -> DataFrame:
    return dims.annotation_dim(spark, None if symbol is None else list(symbol), None if label_store is None else list(label_store))


wfdb_annotation_decode = _ann.decoded


def window_by_rhythm(x: Recording, onset_criteria: Mapping[str, object], offset_criteria: Mapping[str, object], reference_criteria: Mapping[str, object] | None = None, rhythm_type: str = "sinus") -> Windows:
    a = x.annotations
    if "ann_id" not in a.columns:
        a = a.withColumn("ann_id", F.monotonically_increasing_id())
    return Windows(_ann.rhythm_windows(a, onset_criteria, offset_criteria, reference_criteria, rhythm_type), x)


def window(x: Recording, window_method: str = "rhythm", **options: object) -> Windows:
    if window_method != "rhythm":
        raise ValueError(f"no such way to make windows: {window_method}")
    return window_by_rhythm(x, **options)


def standardize_windows(x: Windows, target_samples: int | None = 500, target_ms: float | None = None, interpolation: str = "linear", align_feature: str | Mapping[str, object] | None = None,
                        preserve_amplitude: bool = True, align_mode: str = "forward", method: str = "time_normalize", preserve_class: bool = False) -> DataFrame | Windows:
    """Windows of one length. With ``align_feature`` windows without it keep their place, with a warning. With
    ``preserve_class`` the result is windows again, each a record of its own under its window's name."""
    if not isinstance(x, Windows):
        raise TypeError("windows are needed")
    if method != "time_normalize":
        raise ValueError(f"no such way to standardize: {method}")
    rate = None
    if target_samples is None and target_ms is not None:
        rate = x.source.records.agg(F.max("frequency")).first()[0]
    n = _wave.target_of(target_samples, target_ms, rate)
    s, shift = x.signal(), None
    if align_feature is not None:
        want = {"type": align_feature} if isinstance(align_feature, str) else align_feature
        a = x.annotations()
        shifts = _wave.feature_shift(a.filter(_ann.criteria(a, want)), n, align_mode)
        if x.table.join(shifts, ["record_id", "window_id"], "left_anti").take(1):
            warnings.warn("some windows have no such feature: they are not shifted", stacklevel=2)
        s = s.join(shifts, ["record_id", "window_id"], "left")
        shift = "shift"
    out = _wave.time_normalized(s, n, interpolation, "value", preserve_amplitude=preserve_amplitude, shift=shift)
    if not preserve_class:
        return out
    named = F.concat("record_id", F.lit("_"), F.col("window_id").cast("string"))
    rows = out.select(named.alias("record_id"), "sample", "label", "value")
    of = x.table.select("record_id", "window_id", named.alias("_name"))
    swap = lambda t: t.join(of.select("record_id", "_name"), "record_id").withColumn("record_id", F.col("_name")).drop("_name")
    source = replace(x.source, signal=rows, records=swap(x.source.records).withColumn("samples", F.lit(n).cast("bigint")), channels=swap(x.source.channels), annotations=x.source.annotations.limit(0))
    return Windows(of.select(F.col("_name").alias("record_id"), "window_id", F.lit(1).alias("onset"), F.lit(n).alias("offset")), source, f"standardized_{method}")


# ---- channels and plots ----------------------------------------------------------------------------------------------


def identify_channel_source(label: str) -> str:
    hit = next((g for g, xs in dims.LEADS.items() if label in xs), None)
    if hit is None:
        raise ValueError(f"unknown channel: {label}")
    return hit


color_channels = _ch.with_colors
add_colors = _ch.with_colors


def plot_data(x: Recording, channels: Sequence[str] = (), time_frame: tuple[float, float] | None = None, mode: str = "dark") -> DataFrame:
    """Rows ready to plot, with colours; channels that match nothing are refused, and so is a frame beyond the record."""
    if time_frame is not None:
        r = x.records.agg(F.min(F.col("samples") / F.col("frequency")), F.min("frequency")).first()
        if time_frame[0] < -1 / r[1] or time_frame[1] > r[0] + 1 / r[1]:
            raise ValueError("the time frame lies beyond the record")
    if channels and not x.channels.filter(_ch.matching(F.col("label"), channels)).take(1):
        raise ValueError("no channel matches")
    p = _ch.plot_data(x.signal, x.channels, x.records, channels, time_frame, value="value")
    c = _ch.with_colors(x.channels, mode=mode).select("record_id", "label", "color").dropDuplicates(["record_id", "label"])
    return p.join(c, ["record_id", "label"], "left")


def boundary_mask(x: Recording) -> DataFrame:
    """Samples with the wave and beat whose bounds hold them."""
    a = x.annotations
    if "ann_id" not in a.columns:
        a = a.withColumn("ann_id", F.monotonically_increasing_id())
    return _ann.in_waves(x.signal, _ann.numbered_bounds(a))


def peak_intervals(x: Recording, channel: str, minimum_interval: int = 100) -> DataFrame:
    """Intervals between peaks beyond the 99 % quantile of a channel, at least ``minimum_interval`` samples apart."""
    s = x.signal.filter(F.col("label") == standard_label(F.lit(channel)))
    level = s.groupBy("record_id", "label").agg(F.percentile("value", 0.99).alias("_q"))
    p = _rhythm.local_maxima(s, "value").join(level, ["record_id", "label"]).filter(F.col("value") > F.col("_q"))
    return _rhythm.intervals_between(_rhythm.apart(p, minimum_interval), ["record_id", "label"])


# ---- features --------------------------------------------------------------------------------------------------------


def _with_rate(x: Recording) -> DataFrame:
    return x.signal.join(x.records.select("record_id", "frequency"), "record_id")


def extract_f_waves(x: Recording, lead: str | None = None, qrs_method: str = "adaptive_svd", f_characteristics: Sequence[str] = ("amplitude",), every: bool = False, excerpt_s: float | None = None, **options: object) -> DataFrame:
    """Atrial features per surface lead (of all leads for a 12-lead recording or with ``every``), of the whole
    lead or by excerpts of so many seconds. ``options``: m and r of the entropy, f_min and f_max of the frequency."""
    leads = _ch.surface_leads(x.channels, lead=lead, every=every or x.twelve_lead).select("record_id", "label").distinct()
    if lead is not None and not leads.take(1):
        raise ValueError(f"no such lead: {lead}")
    return _wave.f_waves(_with_rate(x).join(leads, ["record_id", "label"]), f_characteristics, qrs_method, "value", excerpt_s=excerpt_s, **options)


def detect_qrs(x: Recording, window_s: float = 0.150, mode: str = "rising") -> DataFrame:
    return _wave.qrs(_with_rate(x), "value", window_s=window_s, mode=mode)


detect_QRS = dsp.detect_qrs  # noqa: N816
calculate_approximate_entropy = dsp.approximate_entropy
calculate_dominant_frequency = dsp.dominant_frequency
analyze_atrial_signal = dsp.analyze_atrial_signal
elapsed_time, elapsed_time_short = elapsed, elapsed_short
