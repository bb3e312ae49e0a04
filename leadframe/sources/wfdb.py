"""Waveform Database records as DataFrames: header text, signal (a data source), annotations, and writers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from leadframe.functions.text import make_unique, standard_label, start_time
from leadframe.operators.durable import durable
from leadframe.sources import files
from leadframe.sources import wfdb_format as fmt

#: Frames that one task reads.
FRAMES = 1 << 18


# ---- header ----------------------------------------------------------------------------------------------------------


def read_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, channels) of the header files at ``path`` (a file, a folder or a pattern of .hea files).

    records: record_id, record_name, number_of_channels, frequency, samples, start_time, info (array of key and values).
    channels: record_id, number, file_name, storage_format, adc_gain, adc_baseline, adc_units, adc_resolution, adc_zero,
    initial_value, checksum, blocksize, label. What cannot be read as its type is null; blank lines are passed over.
    Labels are those of :func:`own_labels`, under which the signal's channels come too.
    """
    text = spark.read.option("pathGlobFilter", "*.hea").text(path, wholetext=True)
    f = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.hea$", 1).alias("record_id"), F.split("value", r"\r?\n").alias("l"))
    f = f.withColumn("l", F.filter(F.transform("l", lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" ")))), lambda x: x != ""))
    f = f.withColumn("info", F.filter("l", lambda x: x.startswith("#"))).withColumn("l", F.filter("l", lambda x: ~x.startswith("#")))
    first = F.split(F.get("l", F.lit(0)), r"\s+")
    at = lambda i: F.get(first, F.lit(i))
    words = lambda x: F.split(F.trim(F.regexp_replace(x, "^#", "")), r"\s+")
    info = F.transform("info", lambda x: F.struct(F.get(words(x), F.lit(0)).alias("key"), F.slice(words(x), 2, 10_000).alias("values")))
    n = at(1).try_cast("int")
    records = f.select(
        "record_id", at(0).alias("record_name"), n.alias("number_of_channels"), F.coalesce(at(2).try_cast("double"), F.lit(250.0)).alias("frequency"),
        at(3).try_cast("bigint").alias("samples"), start_time(F.concat_ws(" ", at(4), at(5))).alias("start_time"), info.alias("info"),
    )
    lines = f.select("record_id", n.alias("n"), F.posexplode(F.slice("l", 2, 1_000_000)).alias("pos", "line")).filter(F.col("n").isNull() | (F.col("n") <= 0) | (F.col("pos") < F.col("n")))
    c = F.split("line", r"\s+", 9)
    scale = F.get(c, F.lit(2))
    channels = lines.select(
        "record_id", (F.col("pos") + 1).alias("number"), F.get(c, F.lit(0)).alias("file_name"), F.get(c, F.lit(1)).try_cast("int").alias("storage_format"),
        F.regexp_extract(scale, r"^([^(/]+)", 1).try_cast("double").alias("adc_gain"), F.nullif(F.regexp_extract(scale, r"\(([^)]*)\)", 1), F.lit("")).try_cast("int").alias("adc_baseline"),
        F.coalesce(F.nullif(F.regexp_extract(scale, r"/(.+)$", 1), F.lit("")), F.lit("mV")).alias("adc_units"),
        *(F.get(c, F.lit(i)).try_cast("int").alias(x) for i, x in ((3, "adc_resolution"), (4, "adc_zero"), (5, "initial_value"), (6, "checksum"), (7, "blocksize"))),
        F.trim(F.get(c, F.lit(8))).alias("_label"),
    )
    blank = F.coalesce("_label", F.lit("")) == ""
    channels = channels.withColumn("_label", F.when(blank, F.concat(F.lit("CH"), F.col("number").cast("string"))).otherwise(standard_label(F.col("_label"))))
    return records, make_unique(channels, ["record_id"], "_label", "number", "label").drop("_label")


def own_labels(labels: Sequence[str | None]) -> list[str]:
    """The names of a record's channels: in standard form, CH<number> where a label is blank, each once (ECG, ECG_1, ...;
    suffixes that are taken are passed over)."""
    plain = [x.strip().upper().replace("_", " ") if x and x.strip() else f"CH{i + 1}" for i, x in enumerate(labels)]
    taken, out = set(plain), []

    def suffixed(x: str) -> Iterator[str]:
        return (y for k in itertools.count(1) if (y := f"{x}_{k}") not in taken)

    free = {x: suffixed(x) for x in taken}
    for i, x in enumerate(plain):
        out.append(next(free[x]) if x in plain[:i] else x)
    return out


def header_text(record: dict, channels: Sequence[dict], info: Sequence[tuple[str, Sequence[str]]] = ()) -> str:
    """Header file of one record; numbers in their shortest exact form, blanks in units as underscores."""
    num = lambda v, d: d if v is None else f"{v:.17g}" if float(v) != float(f"{v:g}") else f"{v:g}"
    start = record.get("start_time")
    when = [start.strftime("%H:%M:%S %d/%m/%Y")] if start is not None else []
    out = [" ".join([record["record_name"], str(len(channels)), num(record.get("frequency"), "250"), str(record.get("samples") or 0), *when])]
    for c in channels:
        base = "" if c.get("adc_baseline") is None else f"({c['adc_baseline']})"
        out.append(
            "\t".join(
                [c["file_name"], str(c["storage_format"]), f"{num(c.get('adc_gain'), '200')}{base}/{'_'.join((c.get('adc_units') or '').split()) or 'mV'}"]
                + [str(d if c.get(k) is None else c[k]) for k, d in (("adc_resolution", 12), ("adc_zero", 0), ("initial_value", 0), ("checksum", 0), ("blocksize", 0))]
                + [c.get("label") or ""]
            )
        )
    for key, values in info:
        if not key:
            raise ValueError("info strings must be named")
        out.append(" ".join(["#", key, *map(str, values)]))
    return "\n".join(out) + "\n"


# ---- signal ----------------------------------------------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    record: str
    folder: str
    file: str
    formats: tuple[int, ...]
    gains: tuple[float, ...]
    baselines: tuple[int, ...]
    picks: tuple[tuple[int, str], ...]
    begin: int
    end: int


class WfdbSource(DataSource):
    """Signal of records in a folder (path or URI) that all executors see: (record_id, sample, label, value), long, samples from 0.

    Options: ``path``, ``records`` (names, comma-separated; default all), ``begin`` and ``end`` (samples, half open),
    ``channels`` (names or 1-based places, comma-separated), ``units`` (digital or physical), ``frames`` (per task).
    Tasks seek to their frames; a filter on sample narrows them.
    """

    @classmethod
    def name(cls) -> str:
        return "leadframe_wfdb"

    def schema(self) -> str:
        return "record_id string, sample int, label string, value double"

    def reader(self, schema: object) -> WfdbReader:
        return WfdbReader(dict(self.options))


def parse_header(text: str) -> tuple[list[str], list[list[str]]]:
    """Words of the record line and of each channel line."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    n = int(first[1]) if len(first) > 1 and first[1].isdigit() and int(first[1]) else len(lines) - 1
    return first, [x.split(None, 8) for x in lines[1 : n + 1]]


def _scale(word: str) -> tuple[float, int]:
    head, _, _ = word.partition("/")
    gain, _, base = head.partition("(")
    try:
        g = float(gain)
    except ValueError:
        g = 200.0
    base = base.rstrip(")")
    return g, int(base) if base.lstrip("-").isdigit() else 0


def pick_channels(labels: Sequence[str], wanted: Sequence[str]) -> list[tuple[int, str]]:
    """Places (from 0) of the wanted channels: a whole number is a 1-based place; a name matches exactly, else in any case."""
    out = []
    for w in wanted:
        if w.isdigit():
            hit = [int(w) - 1] if 0 < int(w) <= len(labels) else []
        else:
            hit = [i for i, x in enumerate(labels) if x == w] or [i for i, x in enumerate(labels) if x.lower() == w.lower()]
        if not hit:
            raise ValueError(f"no such channel: {w}")
        out.append((hit[0], labels[hit[0]]))
    return out


class WfdbReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.low, self.high = int(options.get("begin") or 0), int(options["end"]) if options.get("end") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan, LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("sample",):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f  # Spark checks rows once more

    def partitions(self) -> list[InputPartition]:
        folder = self.options["path"]
        names = [x for x in self.options.get("records", "").split(",") if x] or files.names(folder, ".hea")
        for name in names:
            if not files.exists(folder, f"{name}.hea"):
                raise FileNotFoundError(f"{name} not found in {folder}")
        step = int(self.options.get("frames", FRAMES))
        physical = self.options.get("units", "digital") == "physical"
        out: list[InputPartition] = []
        for name, text in zip(names, files.read_all(folder, [f"{name}.hea" for name in names]), strict=True):
            first, lines = parse_header(text.decode())
            if len({x[0] for x in lines}) > 1:
                raise ValueError(f"{name}: records over several signal files are not supported")
            if not lines:
                continue
            formats = tuple(int(x[1]) for x in lines)
            labels = own_labels([x[8] if len(x) > 8 else None for x in lines])
            wanted = [x.strip() for x in self.options.get("channels", "").split(",") if x.strip()]
            picks = pick_channels(labels, wanted) if wanted else list(enumerate(labels))
            scales = [_scale(x[2]) if len(x) > 2 else (200.0, 0) for x in lines]
            _, size = fmt.layout(formats)
            total = int(first[3]) if len(first) > 3 and first[3].isdigit() else 0
            if total <= 0:
                held = files.size(folder, lines[0][0])
                if held % size:
                    raise ValueError(f"{name}: the signal file does not hold whole frames")
                total = held // size
            low, high = max(0, self.low), total if self.high is None else min(total, self.high)
            gains = tuple(g if physical else 1.0 for g, _ in scales)
            baselines = tuple(b if physical else 0 for _, b in scales)
            out += [_Range(name, folder, lines[0][0], formats, gains, baselines, tuple(picks), a, min(a + step, high)) for a in range(low, high, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        _, size = fmt.layout(partition.formats)
        system, path = files.filesystem(partition.folder)
        with system.open_input_file(f"{path}/{partition.file}") as f:
            f.seek(partition.begin * size)
            at = partition.begin
            while at < partition.end:
                n = min(1 << 14, partition.end - at)
                counts = fmt.decode(f.read(n * size), partition.formats, [i for i, _ in partition.picks])
                if not len(counts):
                    break
                for k, (i, label) in enumerate(partition.picks):
                    value = counts[:, k] - partition.baselines[i]
                    gain = partition.gains[i]
                    value = value / gain if gain else value.astype(float)
                    m = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.record] * m), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array([label] * m), pa.array(value.astype(float))],
                        names=["record_id", "sample", "label", "value"],
                    )
                at += len(counts)


def read_signal(spark: SparkSession, folder: str, records: Sequence[str] = (), channels: Sequence[str | int] = (), begin: int = 0, end: int | None = None, units: str = "digital", frames: int = FRAMES) -> DataFrame:
    """Signal of the records in ``folder`` (a path or URI; default: all), long. See :class:`WfdbSource`."""
    if units not in ("digital", "physical"):
        raise ValueError("units are digital or physical")
    # Without this a Python source that takes filters does not start.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WfdbSource)
    r = spark.read.format("leadframe_wfdb").option("units", units).option("begin", begin).option("frames", frames)
    if records:
        r = r.option("records", ",".join(records))
    if channels:
        r = r.option("channels", ",".join(map(str, channels)))
    if end is not None:
        r = r.option("end", max(end, begin))
    return r.option("path", folder).load()


# ---- annotations -----------------------------------------------------------------------------------------------------

_MARKS = "record_id string, annotator string, sample int, type string, subtype int, channel int, number int, row_no int"


def read_annotations(spark: SparkSession, folder: str, annotator: str, records: Sequence[str] = ()) -> DataFrame:
    """Marks of the files ``<record>.<annotator>`` in ``folder``; one file is decoded by one task. Empty files give no rows."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{annotator}").load(folder).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1][: -len(annotator) - 1]
                marks = fmt.decode_annotations(content)
                cols = [[name] * len(marks), [annotator] * len(marks), *([m[k] for m in marks] for k in ("sample", "type", "subtype", "channel", "number")), list(range(len(marks)))]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                names = ["record_id", "annotator", "sample", "type", "subtype", "channel", "number", "row_no"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    out = found.mapInArrow(work, _MARKS)
    return out.filter(F.col("record_id").isin(*records)) if records else out


def write_annotations(annotations: DataFrame, folder: str, annotator: str, key: str = "record_id") -> DataFrame:
    """One file per record, written aside and then moved; returns (record_id, path, marks) once all are written.

    Rows with a null sample are refused. Of equal samples, ``row_no`` decides if there is one.
    """
    files.make(folder)
    order = ["sample"] + (["row_no"] if "row_no" in annotations.columns else [])
    a = annotations.select(F.col(key).alias("record_id"), "sample", "type", "subtype", "channel", "number", *order[1:])

    def work(t: pa.Table) -> pa.Table:
        marks = t.sort_by([(c, "ascending") for c in order]).to_pylist()
        if any(m["sample"] is None for m in marks):
            raise ValueError("an annotation has no sample")
        name = marks[0]["record_id"]
        files.put(folder, f"{name}.{annotator}", fmt.encode_annotations(marks))
        return pa.table({"record_id": [name], "path": [f"{folder}/{name}.{annotator}"], "marks": pa.array([len(marks)], pa.int32())})

    return durable(a.groupBy("record_id").applyInArrow(work, "record_id string, path string, marks int"))


# ---- writer ----------------------------------------------------------------------------------------------------------


def _numbered(signal: DataFrame, channels: DataFrame) -> DataFrame:
    """(record_id, label, number) for every label of the signal, null ones too; ValueError if one has no channel.

    A label is first looked for as it is, then in standard form among the channels that are left; a channel without any label is
    CH<number>.
    """
    plain = F.coalesce(F.trim("label"), F.lit(""))
    named = F.when(plain == "", F.concat(F.lit("CH"), F.col("number").cast("string"))).otherwise(plain)
    own = channels.select("record_id", "number", named.alias("name"))
    has = own.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("number", "name"))).alias("_own"))
    given = signal.groupBy("record_id").agg(F.array_sort(F.collect_set(F.coalesce("label", F.lit("")))).alias("_given"))
    both = given.join(has, "record_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast(dict(has.dtypes)["_own"])))

    def matched(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for record, given_, own_ in zip(rows["record_id"].to_pylist(), rows["_given"].to_pylist(), rows["_own"].to_pylist(), strict=True):
            left = [(c["number"], c["name"]) for c in own_]
            found: dict[str, int] = {}
            for form in (lambda x: x, lambda x: x.strip().upper().replace("_", " ")):
                for label in [x for x in given_ if x not in found]:
                    hit = next((c for c in left if form(c[1]) == form(label)), None)
                    if hit:
                        found[label] = hit[0]
                        left.remove(hit)
            over = [x for x in given_ if x not in found]
            # A long table has no order of columns, so places are known only where one label and one channel are left.
            if len(over) == 1 and len(left) == 1 and len(given_) == len(own_):
                found[over.pop()] = left[0][0]
            if over:
                raise ValueError(f"{record}: no channel for the signal's label {', '.join(over) or '(none)'}")
            out += [(record, k, v) for k, v in found.items()]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"record_id": pa.array(cols[0], pa.string()), "label": pa.array(cols[1], pa.string()), "number": pa.array(cols[2], pa.int32())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from matched(pa.Table.from_batches([b])).to_batches()

    try:
        return durable(both.mapInArrow(work, "record_id string, label string, number int"))
    except Exception as e:  # the task's error, as the caller's
        if "no channel for the signal's label" in str(e):
            raise ValueError(next(x for x in str(e).splitlines() if "no channel for" in x).split("ValueError: ")[-1]) from None
        raise


def write_headers(records: DataFrame, channels: DataFrame, folder: str) -> DataFrame:
    """``<record>.hea`` per record, of (record_id, record_name, frequency, samples, start_time[, info]) and channels; returns
    (``name``, ``bytes``). Labels are written as they are, null ones blank."""
    heads = _heads(records, channels)

    def text(b: pa.RecordBatch) -> list[str]:
        return [header_text(h, c, e) for h, c, e in (_head_of(r) for r in b.to_pylist())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{x}.hea" for x in b["record_id"].to_pylist()], pa.string()), pa.array(text(b), pa.string())], names=["name", "content"])

    return files.write_files(heads.mapInArrow(work, "name string, content string"), folder)


def _heads(records: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per record with its channels and info as JSON."""
    c = channels.select("record_id", F.struct(*[x for x in channels.columns if x != "record_id"]).alias("_c"))
    heads = c.groupBy("record_id").agg(F.to_json(F.array_sort(F.collect_list("_c"), lambda a, b: a["number"] - b["number"])).alias("channels"))
    info = F.to_json("info") if "info" in records.columns else F.lit("[]")
    when = F.date_format("start_time", "yyyy-MM-dd HH:mm:ss") if "start_time" in records.columns else F.lit(None).cast("string")
    samples = F.col("samples").cast("bigint") if "samples" in records.columns else F.lit(None).cast("bigint")
    return heads.join(records.select("record_id", "record_name", "frequency", samples.alias("samples"), when.alias("start_time"), info.alias("info")), "record_id")


def _head_of(row: Mapping) -> tuple[dict, list[dict], list[tuple]]:
    import json
    from datetime import datetime

    start = datetime.strptime(row["start_time"], "%Y-%m-%d %H:%M:%S") if row["start_time"] else None
    channels = [{"file_name": f"{row['record_id']}.dat"} | c for c in json.loads(row["channels"])]
    for c in channels:
        c["storage_format"] = 16 if c.get("storage_format") is None else c["storage_format"]
    extra = [(x.get("key"), x.get("values") or []) for x in json.loads(row["info"] or "[]")]
    return {"record_name": row["record_name"], "frequency": row["frequency"], "samples": row["samples"], "start_time": start}, channels, extra


def write_records(signal: DataFrame, records: DataFrame, channels: DataFrame, folder: str, units: str = "digital") -> DataFrame:
    """``<record>.dat`` and ``<record>.hea`` per record; returns (record_id, path, frames).

    ``signal`` is long; its labels are matched with the channels' as they are, then in standard form (a channel without a label
    is CH<number>). If as many labels as channels are there and one of each is left, these go together; any other label
    without a channel is an error. A channel without samples holds 0, and so do null readings and those that are not finite. In
    physical units counts are value * gain + baseline (a gain of 0 multiplies nothing), rounded half away from zero; all counts are held in the range of the
    channel's format. A record's rows are sorted in one task and written as they stream by, so that its length does not
    matter; files are written under a name of the task's attempt and then moved, so that a repeated task does no harm.
    """
    files.make(folder)
    heads = _heads(records, channels).drop("samples")
    order = _numbered(signal, channels).join(channels.select("record_id", "number", "adc_gain", "adc_baseline"), ["record_id", "number"])
    s = signal.filter(F.col("sample").isNotNull()).select("record_id", "sample", F.coalesce("label", F.lit("")).alias("label"), "value").join(order, ["record_id", "label"])
    if units == "physical":
        gain = F.coalesce("adc_gain", F.lit(200.0))
        s = s.withColumn("value", F.col("value") * F.when(gain == 0, 1.0).otherwise(gain) + F.coalesce("adc_baseline", F.lit(0)))
    value = F.col("value").cast("double")
    whole = F.when(~F.isnan(value) & (F.abs(value) < 9e18), F.round(value)).cast("bigint")
    frames = s.groupBy("record_id", "sample").agg(F.collect_list(F.struct("number", F.coalesce(whole, F.lit(0)).alias("v"))).alias("v"))
    # The head of a record comes once, before its frames.
    head = heads.select("record_id", F.lit(None).cast("int").alias("sample"), F.lit(None).cast("array<struct<number:int,v:bigint>>").alias("v"), F.to_json(F.struct(*heads.columns)).alias("head"))
    rows = frames.withColumn("sample", F.col("sample").cast("int")).withColumn("head", F.lit(None).cast("string")).unionByName(head.join(frames.select("record_id").distinct(), "record_id", "left_semi"))
    rows = rows.repartition("record_id").sortWithinPartitions("record_id", F.col("sample").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        state: dict = {}

        def close() -> list[tuple]:
            if not state:
                return []
            state["f"].close()
            name = state["name"]
            chans = [x | {"file_name": f"{name}.dat"} for x in state["channels"]]
            files.put(folder, f"{name}.hea", header_text(state["head"] | {"samples": state["n"]}, chans, state["extra"]).encode())
            done = [(name, f"{folder}/{name}.hea", state["n"])]
            state.clear()
            return done

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["record_id", "path", "frames"])

        for b in batches:
            done: list[tuple] = []
            heads_, cut = b["head"].to_pylist(), b["v"].offsets.to_numpy()
            numbers, values = (b["v"].values.field(k).to_numpy() for k in ("number", "v"))
            starts = [i for i, h in enumerate(heads_) if h is not None]
            for i, z in zip([-1, *starts], [*starts, len(heads_)], strict=True):
                if i >= 0:
                    done += close()
                    row = {"samples": None, "start_time": None, "info": None, "frequency": None} | json.loads(heads_[i])
                    head_, chans, extra = _head_of(row)
                    place = np.full(max(c["number"] for c in chans) + 1, -1)
                    place[[c["number"] for c in chans]] = np.arange(len(chans))
                    state.update(name=row["record_id"], head=head_, channels=chans, extra=extra, place=place, n=0, f=files.Aside(folder, f"{row['record_id']}.dat"))
                a, n = i + 1, z - i - 1
                if n:
                    counts = np.zeros((n, len(state["channels"])), np.int64)
                    own = slice(cut[a], cut[z])
                    counts[np.repeat(np.arange(n), np.diff(cut[a : z + 1])), state["place"][numbers[own]]] = values[own]
                    state["f"].write(fmt.encode(counts, [x["storage_format"] for x in state["channels"]]))
                    state["n"] += n
            if done:
                yield batch(done)
        end = close()
        if end:
            yield batch(end)

    return durable(rows.mapInArrow(work, "record_id string, path string, frames bigint"))
