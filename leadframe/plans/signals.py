"""Queries over recordings: channels, annotations, windows, peaks and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadframe.functions import text
from leadframe.functions.dims import ANNOTATIONS, LABELS, LEADS, PALETTE, SURFACE, annotation_dim
from leadframe.functions.expr import sound
from leadframe.operators import annotations as ann_ops
from leadframe.operators import channels as ch
from leadframe.operators import rhythm, units, waveforms
from leadframe.sources.tables import table

ONSET, OFFSET, REFERENCE = {"type": "(", "number": 0}, {"type": ")", "number": 2}, {"type": "N"}


# ---- tables without re-delivered rows --------------------------------------------------------------------------------


def annotations(spark: SparkSession, d: str, annotator: str | None = None) -> DataFrame:
    a = table(spark, d, "annotation_table", "ann_id", "record_id", "annotator", "time", "sample", "type", "subtype", "channel", "number")
    return (a.filter(F.col("annotator") == annotator) if annotator else a).distinct()


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """All readings in mV as they came, some more than once; one that is not finite is null."""
    return table(spark, d, "ggm", "record_id", "label", "sample", sound("mv", None).alias("mv"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """All readings in mV, each in its place; one that is not finite is null."""
    return delivered(spark, d).distinct()


def channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "header_table").drop("loaded_at").distinct()


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").drop("loaded_at").distinct()


def rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records", "record_id", "frequency").distinct()


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Converter counts, long: (record_id, sample, label, value)."""
    s = table(spark, d, "signal_table").distinct()
    names = [c for c in s.columns if c not in ("record_id", "sample")]
    s = ch.long_signal(s, names).filter(F.col("value").isNotNull())
    label = F.create_map(*[F.lit(x) for n in names for x in (n, _COLUMN_LABEL.get(n, n.upper()))])
    return s.withColumn("label", label[F.col("label")])


# The signal table's columns and the labels they stand for.
_COLUMN_LABEL = {"i": "I", "ii": "II", "v1": "V1", "cs_1_2": "CS 1-2", "rv_1_2": "RV 1-2", "abl_d": "ABL D"}

_A = "a AS (SELECT DISTINCT ann_id, record_id, annotator, time, sample, type, subtype, channel, number FROM annotation_table)"
_G = "g AS (SELECT DISTINCT record_id, label, sample, CASE WHEN isfinite(mv) THEN mv END AS mv FROM ggm)"
#: Along a channel a reading beyond 50 mV keeps its place and is missing.
_S = "f AS (SELECT record_id, label, sample, CASE WHEN abs(mv) <= 50 THEN mv END AS mv FROM g)"
_C = "c AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM header_table)"
_R = "r AS (SELECT DISTINCT record_id, frequency FROM records)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {_q(s)}, {_q(m)}, {_q(t)})" for c, s, m, t in ANNOTATIONS) + ") t(label_store, symbol, mnemonic, description))"
_LEADS = "leads AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(x)}, {_q(g)}, {LABELS.index(x)})" for g, xs in LEADS.items() for x in xs) + ") t(label, lead_group, ord))"
_PALETTE = "palette AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(g)}, {i}, {_q(c)})" for g, cs in PALETTE.items() for i, c in enumerate(cs)) + ") t(lead_group, i, color))"
_STD = "replace(upper(label), '_', ' ')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- annotations -----------------------------------------------------------------------------------------------------


@query(f"WITH {_A} SELECT ann_id, record_id, sample, type FROM a WHERE annotator = 'ecgpuwave' AND type = 'N' AND number = 0")
def annotation_filter(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    return a.filter(ann_ops.criteria(a, {"annotator": "ecgpuwave", "type": "N", "number": 0})).select("ann_id", "record_id", "sample", "type")


@query(f"WITH {_A}, {_R} SELECT ann_id, record_id, sample FROM a JOIN r USING (record_id) WHERE frequency > 0 AND sample >= floor(1.0 * frequency) AND sample <= ceil(2.5 * frequency)")
def time_range_closed(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.within_time(annotations(spark, d).join(rates(spark, d), "record_id"), 1.0, 2.5).select("ann_id", "record_id", "sample")


@query(f"WITH {_A}, {_DIM} SELECT ann_id, record_id, type, label_store, mnemonic, description FROM a LEFT JOIN dim ON type = symbol")
def annotation_decode_left_join(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.decoded(annotations(spark, d)).select("ann_id", "record_id", "type", "label_store", "mnemonic", "description")


@query(f"WITH {_A}, {_DIM} SELECT ann_id, number, symbol, mnemonic FROM a LEFT JOIN dim ON number = label_store")
def annotation_decode_by_code(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.decoded(annotations(spark, d), "number").select("ann_id", "number", "symbol", "mnemonic")


@query(f"WITH {_DIM} SELECT * FROM dim WHERE symbol IN ('N', 'V', '(') AND label_store IN (1, 5, 7)")
def annotation_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return annotation_dim(spark, ["N", "V", "("], [1, 5, 7])


_ELAPSED_SQL = "format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"


@query(
    f"WITH {_A}, {_R}, x AS (SELECT ann_id, sample, time, type, subtype, channel, number, CAST(round_even(sample * 1000.0 / frequency, 0) AS BIGINT) AS ms FROM a JOIN r USING (record_id)) "
    f"SELECT ann_id, coalesce(type, '') AS type, coalesce(subtype, '') AS subtype, coalesce(channel, 0) AS channel, coalesce(number, 0) AS number, "
    f"coalesce(time, rtrim(rtrim({_ELAPSED_SQL}, '0'), '.'), '') AS time FROM x"
)
def annotation_fill(spark: SparkSession, d: str) -> DataFrame:
    a = ann_ops.filled(annotations(spark, d).join(rates(spark, d), "record_id"), "frequency")
    return a.select("ann_id", "type", "subtype", "channel", "number", "time")


@query(f"WITH {_A}, {_R}, x AS (SELECT ann_id, CAST(round_even(sample * 1000.0 / frequency, 0) AS BIGINT) AS ms FROM a JOIN r USING (record_id) WHERE sample IS NOT NULL) SELECT ann_id, {_ELAPSED_SQL} AS elapsed FROM x")
def elapsed_time_format(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).join(rates(spark, d), "record_id").filter(F.col("sample").isNotNull())
    return a.select("ann_id", text.elapsed(F.col("sample"), F.col("frequency")).alias("elapsed"))


def _pad(c: str, n: int) -> str:
    return f"CASE WHEN length(coalesce(CAST({c} AS VARCHAR), '')) < {n} THEN lpad(coalesce(CAST({c} AS VARCHAR), ''), {n}, ' ') ELSE CAST({c} AS VARCHAR) END"


@query(f"WITH {_A} SELECT ann_id, " + " || ".join(_pad(c, n) for c, n in (("time", 12), ("sample", 9), ("type", 6), ("subtype", 5), ("channel", 5), ("number", 5))) + " AS line FROM a")
def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).select("ann_id", text.annotation_line("time", "sample", "type", "subtype", "channel", "number").alias("line"))


@query(
    "SELECT DISTINCT record_id, strftime(coalesce(try_strptime(t, '%H:%M:%S %d/%m/%Y'), try_strptime(t, '%m/%d/%Y %I:%M:%S %p'), CASE WHEN regexp_full_match(t, '\\d\\d-\\d\\d-\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(t, '%m-%d-%Y %H:%M:%S') END), '%H:%M:%S %d/%m/%Y') AS start_line "
    "FROM (SELECT record_id, trim(regexp_replace(start_time, '[.]\\d+ ', ' ')) AS t FROM header_table WHERE start_time IS NOT NULL) WHERE start_line IS NOT NULL"
)
def start_time_parse(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "header_table", "record_id", "start_time").filter(F.col("start_time").isNotNull()).distinct()
    return h.select("record_id", text.start_line(text.start_time(F.col("start_time"))).alias("start_line")).filter("start_line is not null").distinct()


_BOUNDS = f"""{_A}, n AS (SELECT record_id, sample, type, ann_id, CASE number WHEN 0 THEN 'p' WHEN 1 THEN 'qrs' WHEN 2 THEN 't' ELSE CAST(number AS VARCHAR) END AS wave FROM a
  WHERE annotator = 'ecgpuwave' AND type IN ('(', ')') AND sample IS NOT NULL AND number IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id, wave, type ORDER BY sample, ann_id) AS k FROM n),
b AS (SELECT record_id, wave, wave || k AS beat, max(CASE WHEN type = '(' THEN sample END) AS onset, max(CASE WHEN type = ')' THEN sample END) AS "offset" FROM k GROUP BY record_id, wave, k)"""


@query(f"WITH {_BOUNDS} SELECT * FROM b")
def pivot_onset_offset(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.numbered_bounds(annotations(spark, d, "ecgpuwave"))


@query(
    f"WITH {_A}, x AS (SELECT ann_id, sample, type, lead(type) OVER w AS nx, lag(type) OVER w AS pv, record_id FROM a WHERE annotator = 'ecgpuwave' AND sample IS NOT NULL WINDOW w AS (PARTITION BY record_id ORDER BY sample, ann_id)), "
    "y AS (SELECT record_id, ann_id, sample, type, CASE type WHEN '(' THEN nx ELSE pv END AS w FROM x WHERE type IN ('(', ')')) SELECT record_id, ann_id, sample, type, CASE w WHEN 'N' THEN 'qrs' ELSE w END AS wave FROM y"
)
def wave_beat_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.waves_by_neighbour(annotations(spark, d, "ecgpuwave"))


@query(
    f"WITH {_BOUNDS}, {_G}, s AS (SELECT DISTINCT record_id, sample FROM g), h AS (SELECT s.*, b.wave, b.beat, row_number() OVER (PARTITION BY s.record_id, s.sample ORDER BY b.onset DESC NULLS LAST, b.beat DESC) AS k "
    'FROM s LEFT JOIN b ON s.record_id = b.record_id AND s.sample >= b.onset AND s.sample < b."offset") SELECT record_id, sample, wave, beat FROM h WHERE k = 1'
)
def interval_join_waves(spark: SparkSession, d: str) -> DataFrame:
    s = readings(spark, d).select("record_id", "sample").distinct()
    return ann_ops.in_waves(s, ann_ops.numbered_bounds(annotations(spark, d, "ecgpuwave")))


@query(
    f"WITH {_BOUNDS}, {_G}, lb AS (SELECT DISTINCT g.label, b.* FROM b JOIN (SELECT DISTINCT record_id, label FROM g) g USING (record_id) WHERE b.wave = 'qrs'), "
    "h AS (SELECT g.record_id, g.label, g.sample, lb.beat, row_number() OVER (PARTITION BY g.record_id, g.label, g.sample ORDER BY lb.onset DESC NULLS LAST, lb.beat DESC) AS k "
    'FROM g LEFT JOIN lb ON g.record_id = lb.record_id AND g.label = lb.label AND g.sample >= lb.onset AND g.sample < lb."offset") SELECT record_id, label, sample, beat FROM h WHERE k = 1'
)
def interval_join_lead_waves(spark: SparkSession, d: str) -> DataFrame:
    g = readings(spark, d).select("record_id", "label", "sample")
    b = ann_ops.numbered_bounds(annotations(spark, d, "ecgpuwave")).filter("wave = 'qrs'")
    by_lead = b.join(g.select("record_id", "label").distinct(), "record_id")
    return ann_ops.in_waves(g, by_lead, ["record_id", "label"]).select("record_id", "label", "sample", "beat")


# ---- rhythm windows --------------------------------------------------------------------------------------------------

_W = """RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"""


def _windows_sql(reference: bool, sinus: bool) -> str:
    keep = ["is_on", "nx_off IS NOT NULL"] + ["nx_ref < nx_off"] * reference + ["(nx_on IS NULL OR nx_on >= nx_off)"] * sinus
    return f"""{_A}, e AS (SELECT ann_id, record_id, sample, coalesce(type = '(' AND number = 0, false) AS is_on, coalesce(type = ')' AND number = 2, false) AS is_off, coalesce(type = 'N', false) AS is_ref
  FROM a WHERE annotator = 'ecgpuwave' AND sample IS NOT NULL),
n AS (SELECT *, min(CASE WHEN is_off THEN sample END) OVER w AS nx_off, min(CASE WHEN is_ref THEN sample END) OVER w AS nx_ref, min(CASE WHEN is_on THEN sample END) OVER w AS nx_on
  FROM e WINDOW w AS (PARTITION BY record_id ORDER BY sample {_W})),
w AS (SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY sample, ann_id) AS INTEGER) AS window_id, sample AS onset, nx_off AS "offset", {"nx_ref" if reference else "CAST(NULL AS INTEGER)"} AS qrs
  FROM n WHERE {" AND ".join(keep)})"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.rhythm_windows(annotations(spark, d, "ecgpuwave"), ONSET, OFFSET, REFERENCE)


@query(f"WITH {_windows_sql(True, True)} SELECT *, record_id || '_sinus' || window_id AS window_record_name FROM w")
def rhythm_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query(f'WITH {_windows_sql(False, False)} SELECT record_id, window_id, onset, "offset" FROM w')
def next_offset_asof(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.rhythm_windows(annotations(spark, d, "ecgpuwave"), ONSET, OFFSET, None, "any").select("record_id", "window_id", "onset", "offset")


@query(f'WITH {_windows_sql(True, False)} SELECT record_id, window_id, onset, "offset", qrs FROM w')
def reference_semi(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.rhythm_windows(annotations(spark, d, "ecgpuwave"), ONSET, OFFSET, REFERENCE, "any").select("record_id", "window_id", "onset", "offset", "qrs")


@query(f'WITH {_windows_sql(False, True)} SELECT record_id, window_id, onset, "offset" FROM w')
def nested_onset_anti(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.rhythm_windows(annotations(spark, d, "ecgpuwave"), ONSET, OFFSET, None, "sinus").select("record_id", "window_id", "onset", "offset")


@query(f'WITH {_windows_sql(True, True)}, {_G} SELECT g.record_id, g.label, g.sample, round(g.mv, 6) AS mv, w.window_id FROM g JOIN w ON g.record_id = w.record_id AND g.sample BETWEEN w.onset AND w."offset"')
def rhythm_window_signal(spark: SparkSession, d: str) -> DataFrame:
    return ann_ops.window_signal(readings(spark, d), _windows(spark, d)).withColumn("mv", F.round("mv", 6))


@query(
    f'WITH {_windows_sql(True, True)} SELECT a.ann_id, a.record_id, a.type, a.sample - w.onset + 1 AS sample, w.window_id FROM a JOIN w ON a.record_id = w.record_id AND a.sample BETWEEN w.onset AND w."offset" WHERE a.annotator = \'ecgpuwave\''
)
def rhythm_window_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d, "ecgpuwave").filter(F.col("sample").isNotNull())
    return ann_ops.window_annotations(a, _windows(spark, d)).select("ann_id", "record_id", "type", "sample", "window_id")


@query(
    f'WITH {_windows_sql(True, True)}, {_G} SELECT g.record_id, w.window_id, g.label, round(max(g.mv) - min(g.mv), 6) AS peak_to_peak FROM g JOIN w ON g.record_id = w.record_id AND g.sample BETWEEN w.onset AND w."offset" GROUP BY ALL'
)
def window_peak_to_peak(spark: SparkSession, d: str) -> DataFrame:
    p = ann_ops.peak_to_peak(ann_ops.window_signal(readings(spark, d), _windows(spark, d)))
    return p.withColumn("peak_to_peak", F.round("peak_to_peak", 6))


@query(
    f"WITH {_windows_sql(True, True)}, o AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY sample, ann_id) AS window_id, sample AS onset, nx_off AS \"offset\" FROM n WHERE is_on AND nx_off IS NOT NULL), "
    'v AS (SELECT 0 AS part, record_id, window_id, onset, "offset" FROM w UNION ALL SELECT 1, record_id, window_id, onset, "offset" FROM o) '
    'SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY part, onset, window_id) AS INTEGER) AS window_id, onset, "offset" FROM v'
)
def window_concat_union(spark: SparkSession, d: str) -> DataFrame:
    every = ann_ops.rhythm_windows(annotations(spark, d, "ecgpuwave"), ONSET, OFFSET, None, "any")
    return ann_ops.concat_windows(_windows(spark, d), every).select("record_id", "window_id", "onset", "offset")


@query(
    f"WITH {_windows_sql(True, True)}, {_G}, p AS (SELECT DISTINCT record_id, qrs AS point FROM w) SELECT g.record_id, p.point, g.sample - p.point AS k, g.label, round(g.mv, 6) AS mv FROM p JOIN g ON g.record_id = p.record_id AND g.sample BETWEEN p.point - 5 AND p.point + 5"
)
def qrs_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    points = _windows(spark, d).select("record_id", F.col("qrs").alias("sample"))
    n = ann_ops.neighbourhoods(points, readings(spark, d), 5)
    return n.select("record_id", "point", "k", "label", F.round("mv", 6).alias("mv"))


def _normalized_sql(method: str, target: int, preserve: bool, centred: int = 0) -> str:
    if method == "spline":
        return _spline_sql(target)
    value = {"linear": "v[k + 1] + CASE WHEN x > k THEN (x - k) * (v[k + 2] - v[k + 1]) ELSE 0 END", "step": "v[CAST(floor(x + 1e-9) AS BIGINT) + 1]"}[method]
    out = "CASE WHEN hi > lo THEN (y - lo) / (hi - lo) * (list_max(v) - list_min(v)) + list_min(v) ELSE y END" if preserve else "y"
    return f"""WITH {_windows_sql(True, True)}, {_G},
s AS (SELECT g.record_id, w.window_id, g.label, list(g.mv ORDER BY g.sample, g.mv) AS v FROM g JOIN w ON g.record_id = w.record_id AND g.sample BETWEEN w.onset AND w."offset" WHERE g.mv IS NOT NULL GROUP BY ALL),
f AS (SELECT w.record_id, w.window_id, {f"{centred} * (min(a.sample) - w.onset + 1 - {-(-target // 2)})" if centred else "0"} AS shift FROM w JOIN a ON a.record_id = w.record_id AND a.sample BETWEEN w.onset AND w."offset"
  WHERE a.annotator = 'ecgpuwave' AND a.type = 'N' GROUP BY w.record_id, w.window_id, w.onset),
p AS (SELECT s.*, i, greatest(0.0, least(i * (len(v) - 1) / {target - 1}.0 + shift, len(v) - 1.0)) AS x FROM s JOIN f USING (record_id, window_id), unnest(range(0, {target})) t(i)),
q AS (SELECT *, greatest(least(CAST(floor(x) AS BIGINT), len(v) - 2), 0) AS k FROM p),
y AS (SELECT *, {value} AS y FROM q),
z AS (SELECT *, min(y) OVER g AS lo, max(y) OVER g AS hi FROM y WINDOW g AS (PARTITION BY record_id, window_id, label))
SELECT record_id, window_id, label, CAST(i + 1 AS INTEGER) AS sample, round({out}, 6) AS mv FROM z"""


def _spline_sql(target: int) -> str:
    """Natural cubic splines by the inverse of their system in closed form, cut where it has fallen below 1e-23."""
    t = "ln(2 + sqrt(3))"
    green = f"CASE WHEN (a + b) % 2 = 0 THEN 1 ELSE -1 END * exp(-abs(a - b) * {t}) * (1 - exp(-2 * least(a, b) * {t})) * (1 - exp(-2 * (n - 1 - greatest(a, b)) * {t})) / (1 - exp(-2 * (n - 1) * {t})) / (2 * sqrt(3))"
    return f"""WITH {_windows_sql(True, True)}, {_G},
s AS (SELECT g.record_id, w.window_id, g.label, list(g.mv ORDER BY g.sample, g.mv) AS v, count(*) AS n FROM g JOIN w ON g.record_id = w.record_id AND g.sample BETWEEN w.onset AND w."offset" WHERE g.mv IS NOT NULL GROUP BY ALL),
second AS (SELECT record_id, window_id, label, a, sum({green} * 6 * (v[b + 2] - 2 * v[b + 1] + v[b])) AS m FROM s, unnest(range(1, n - 1)) x(a), unnest(range(greatest(a - 40, 1), least(a + 40, n - 2) + 1)) y(b) GROUP BY ALL),
p AS (SELECT s.*, i, i * (n - 1) / {target - 1}.0 AS x, greatest(least(CAST(floor(x) AS BIGINT), n - 2), 0) AS k, x - k AS u FROM s, unnest(range(0, {target})) t(i)),
y AS (SELECT p.record_id, p.window_id, p.label, i, n, v, CASE WHEN n = 1 THEN v[1] ELSE (1 - u) * v[k + 1] + u * v[k + 2] + (pow(1 - u, 3) - (1 - u)) * coalesce(l.m, 0) / 6 + (pow(u, 3) - u) * coalesce(h.m, 0) / 6 END AS y
  FROM p LEFT JOIN second l ON l.record_id = p.record_id AND l.window_id = p.window_id AND l.label = p.label AND l.a = p.k LEFT JOIN second h ON h.record_id = p.record_id AND h.window_id = p.window_id AND h.label = p.label AND h.a = p.k + 1),
z AS (SELECT *, min(y) OVER g AS lo, max(y) OVER g AS hi FROM y WINDOW g AS (PARTITION BY record_id, window_id, label))
SELECT record_id, window_id, label, CAST(i + 1 AS INTEGER) AS sample, round(CASE WHEN hi > lo THEN (y - lo) / (hi - lo) * (list_max(v) - list_min(v)) + list_min(v) ELSE y END, 6) AS mv FROM z"""


def _normalized(spark: SparkSession, d: str, **options) -> DataFrame:
    w = ann_ops.window_signal(readings(spark, d), _windows(spark, d))
    return waveforms.time_normalized(w, **options).withColumn("mv", F.round("mv", 6))


@query(_normalized_sql("linear", 50, False))
def time_normalize_linear(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, target=50, preserve_amplitude=False)


@query(_normalized_sql("step", 50, False))
def time_normalize_step(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, target=50, method="step", preserve_amplitude=False)


@query(_normalized_sql("linear", 50, True))
def amplitude_rescale(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, target=50)


@query(_normalized_sql("spline", 50, True))
def time_normalize_spline(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, target=50, method="spline")


@query(_normalized_sql("linear", 50, True, 1))
def time_normalize_aligned(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    feature = ann_ops.window_annotations(annotations(spark, d, "ecgpuwave").filter("type = 'N' and sample is not null"), w)
    shift = waveforms.feature_shift(feature, 50, "center")
    s = ann_ops.window_signal(readings(spark, d), w).join(shift, ["record_id", "window_id"], "left")
    return waveforms.time_normalized(s, 50, shift="shift").withColumn("mv", F.round("mv", 6))


# ---- channels --------------------------------------------------------------------------------------------------------


@query(f"WITH {_G}, {_R} SELECT record_id, label, sample, round(mv, 6) AS mv FROM g JOIN r USING (record_id) WHERE sample >= round_even(0.5 * frequency, 0) AND sample < round_even(1.5 * frequency, 0)")
def time_range_halfopen(spark: SparkSession, d: str) -> DataFrame:
    s = readings(spark, d).join(rates(spark, d), "record_id")
    inside = (F.col("sample") >= F.bround(0.5 * F.col("frequency"))) & (F.col("sample") < F.bround(1.5 * F.col("frequency")))
    return s.filter(inside).select("record_id", "label", "sample", F.round("mv", 6).alias("mv"))


@query(
    f"WITH {_C}, p AS (SELECT record_id, number, label, row_number() OVER (PARTITION BY record_id ORDER BY number) AS place FROM c), q AS (SELECT * FROM (VALUES (0, 'V1'), (1, 'ii')) t(pick, name)), "
    "n AS (SELECT q.pick, p.record_id, p.number, p.label, row_number() OVER (PARTITION BY record_id, pick ORDER BY p.label = q.name DESC, number) AS k FROM p JOIN q ON lower(p.label) = lower(q.name)) "
    "SELECT record_id, pick, number, label FROM n WHERE k = 1 UNION ALL SELECT record_id, 2, number, label FROM p WHERE place = 1"
)
def channel_select_reorder(spark: SparkSession, d: str) -> DataFrame:
    return ch.select_channels(channels(spark, d), ["V1", "ii", 1]).select("record_id", "pick", "number", "label")


@query(f"WITH {_C} SELECT record_id, number, label FROM c WHERE label = 'V1' OR regexp_matches(label, 'CS')")
def channel_regex_match(spark: SparkSession, d: str) -> DataFrame:
    return channels(spark, d).filter(ch.matching(F.col("label"), ["V1", "CS"])).select("record_id", "number", "label")


_COUNTS = "s AS (SELECT * FROM (UNPIVOT (SELECT DISTINCT * FROM signal_table) ON COLUMNS(* EXCLUDE (record_id, sample)) INTO NAME col VALUE value)), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _COLUMN_LABEL.items()) + ") t(col, label)), v AS (SELECT record_id, sample, label, value FROM s JOIN m USING (col))"


@query(f"WITH {_COUNTS} SELECT * FROM v")
def unpivot_channels(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


_USED = "u AS (SELECT record_id, replace(upper(label), '_', ' ') AS label, max_by(adc_gain, number) FILTER (adc_gain IS NOT NULL) AS gain, max_by(adc_baseline, number) FILTER (adc_baseline IS NOT NULL) AS base, max(storage_format) AS fmt FROM c GROUP BY ALL)"


_HIGH = "CASE coalesce(fmt, 32) WHEN 8 THEN 127 WHEN 80 THEN 127 WHEN 16 THEN 32767 WHEN 24 THEN 8388607 WHEN 32 THEN 2147483647 WHEN 212 THEN 2047 END"


def _scales(spark: SparkSession, d: str) -> DataFrame:
    """By labels in standard form; ``llm.queries`` has the same queries with typed labels resolved."""
    return ch.scales(channels(spark, d))


@query(f"WITH {_COUNTS}, {_C}, {_USED} SELECT v.record_id, v.sample, v.label, round((value - coalesce(base, 0)) / (CASE WHEN gain = 0 THEN 1 ELSE coalesce(gain, 200) END), 6) AS physical FROM v LEFT JOIN u USING (record_id, label)")
def digital_to_physical(spark: SparkSession, d: str) -> DataFrame:
    """Every converter count in mV; a channel that no header label has in standard form has the default gain."""
    s = counts(spark, d).join(_scales(spark, d), ["record_id", "label"], "left")
    return s.select("record_id", "sample", "label", F.round(ch.to_physical(F.col("value"), F.col("gain"), F.col("base")), 6).alias("physical"))


@query(f"WITH {_G}, {_C}, {_USED} SELECT record_id, sample, label, CASE WHEN mv IS NOT NULL THEN CAST(greatest(least(round(mv * CASE WHEN gain = 0 THEN 1 ELSE coalesce(gain, 200) END + coalesce(base, 0)), {_HIGH}), -{_HIGH} - 1) AS INTEGER) END AS digital FROM g LEFT JOIN u USING (record_id, label)")
def physical_to_digital_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Every reading as a count; a channel that no header label has in standard form has the default gain and the widest format."""
    s = readings(spark, d).join(_scales(spark, d), ["record_id", "label"], "left")
    return s.select("record_id", "sample", "label", ch.to_digital(F.col("mv"), F.col("gain"), F.col("base"), F.coalesce("fmt", F.lit(32))).alias("digital"))


@query("SELECT DISTINCT record_id, sample, ii - i AS iii, -(i + ii) / 2 AS avr, i - ii / 2 AS avl, ii - i / 2 AS avf FROM signal_table WHERE i IS NOT NULL AND ii IS NOT NULL")
def derived_leads(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "signal_table", "record_id", "sample", "i", "ii").distinct()
    s = s.filter(F.col("i").isNotNull() & F.col("ii").isNotNull())
    return ch.derived_leads(s).select("record_id", "sample", "iii", "avr", "avl", "avf")


@query(f"WITH {_G} SELECT record_id, sample, round(max(mv) FILTER (label = 'I'), 6) AS lead_i, round(max(mv) FILTER (label = 'II'), 6) AS lead_ii, round(max(mv) FILTER (label = 'V1'), 6) AS lead_v1 FROM g GROUP BY ALL")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    w = ch.wide_signal(readings(spark, d), ["I", "II", "V1"], value="mv")
    return w.select("record_id", "sample", F.round("I", 6).alias("lead_i"), F.round("II", 6).alias("lead_ii"), F.round("V1", 6).alias("lead_v1"))


@query(f"WITH {_G} SELECT record_id, label, min(sample) AS first_sample, count(*) AS n, round(sum(mv), 6) AS total FROM g GROUP BY ALL")
def signal_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = ch.signal_arrays(readings(spark, d), value="mv")
    total = F.aggregate(F.array_compact("values"), F.lit(0.0), lambda acc, x: acc + x)
    return a.select("record_id", "label", "first_sample", F.size("values").cast("bigint").alias("n"), F.round(F.when(F.size(F.array_compact("values")) > 0, total), 6).alias("total"))


@query(
    f"WITH {_G}, {_C}, {_R}, {_LEADS}, f AS (SELECT record_id, {_STD} AS label, min(number) AS number FROM c GROUP BY ALL) "
    "SELECT g.record_id, g.label, g.sample, round(g.sample / r.frequency, 6) AS time, f.number, leads.lead_group, coalesce(leads.ord, 51) AS ord "
    "FROM g JOIN r USING (record_id) LEFT JOIN f ON f.record_id = g.record_id AND f.label = g.label LEFT JOIN leads ON leads.label = g.label "
    "WHERE (g.label IN ('I', 'II') OR regexp_matches(g.label, 'CS')) AND g.sample BETWEEN round_even(0.2 * r.frequency, 0) AND round_even(1.0 * r.frequency, 0)"
)
def channel_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    p = ch.plot_data(readings(spark, d), channels(spark, d), rates(spark, d), ["I", "II", "CS"], (0.2, 1.0))
    return p.select("record_id", "label", "sample", F.round("time", 6).alias("time"), "number", "lead_group", "ord")


@query(
    f"WITH {_C}, {_LEADS}, x AS (SELECT record_id, number, {_STD} AS l FROM c), y AS (SELECT x.*, lead_group, ord, bool_and(ord IS NOT NULL) OVER (PARTITION BY record_id) AS known, row_number() OVER (PARTITION BY record_id, l ORDER BY number) - 1 AS k FROM x LEFT JOIN leads ON l = leads.label) "
    "SELECT record_id, number, CASE WHEN known OR k = 0 THEN l ELSE l || '_' || k END AS label, CASE WHEN known THEN split_part(CASE WHEN lead_group = 'ECG' THEN 'ECG' ELSE l END, ' ', 1) END AS source, CASE WHEN known THEN CASE WHEN lead_group = 'ECG' THEN l ELSE split_part(l, ' ', 2) END END AS lead, ord FROM y"
)
def header_labels(spark: SparkSession, d: str) -> DataFrame:
    return ch.with_sources(channels(spark, d)).select("record_id", "number", "label", "source", "lead", "ord")


@query(f"WITH {_C}, x AS (SELECT *, {_STD} AS l FROM c) SELECT record_id, number, CASE WHEN row_number() OVER w = 1 THEN l ELSE l || '_' || (row_number() OVER w - 1) END AS label FROM x WINDOW w AS (PARTITION BY record_id, l ORDER BY number)")
def make_unique_labels(spark: SparkSession, d: str) -> DataFrame:
    c = channels(spark, d).select("record_id", "number", text.standard_label(F.col("label")).alias("l"))
    return text.make_unique(c, ["record_id"], "l", "number", "label").select("record_id", "number", "label")


@query(
    f"WITH {_C}, x AS (SELECT *, lower(replace(replace(coalesce(range_text, ''), 'µ', 'u'), 'μ', 'u')) AS t FROM c), y AS (SELECT *, CAST(nullif(regexp_extract(t, '([0-9.]+) ?(v|mv|uv|millivolt)$', 1), '') AS DOUBLE) AS v, regexp_extract(t, '[0-9] ?(v|mv|uv|millivolt)$', 1) AS u FROM x) "
    "SELECT record_id, number, round(CASE WHEN adc_saturation > 0 AND v > 0 THEN adc_saturation / (v * CASE u WHEN 'v' THEN 1000 WHEN 'uv' THEN 0.001 ELSE 1 END) ELSE adc_gain END, 6) AS gain FROM y"
)
def header_gain(spark: SparkSession, d: str) -> DataFrame:
    c = channels(spark, d)
    gain = ch.gain_of_range(F.col("adc_saturation"), units.range_mv(F.col("range_text")), F.col("adc_gain"))
    return c.select("record_id", "number", F.round(gain, 6).alias("gain"))


@query(f"WITH {_C}, n AS (SELECT record_id, count(*) AS n FROM c GROUP BY ALL) SELECT r.record_id, CAST(CASE WHEN number_of_channels > 0 THEN number_of_channels ELSE coalesce(n, 0) END AS INTEGER) AS number_of_channels FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM records) r LEFT JOIN n USING (record_id)")
def header_channel_count(spark: SparkSession, d: str) -> DataFrame:
    return ch.channel_counts(records(spark, d), channels(spark, d))


@query(f"WITH {_C}, {_LEADS} SELECT record_id, number, c.label, lead_group FROM c LEFT JOIN leads ON c.label = leads.label")
def channel_source(spark: SparkSession, d: str) -> DataFrame:
    return ch.channel_source(channels(spark, d)).select("record_id", "number", "label", "lead_group")


@query(
    f"WITH {_C}, {_LEADS}, {_PALETTE}, x AS (SELECT record_id, c.label, lead_group, min(number) AS f FROM c JOIN leads ON c.label = leads.label GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY record_id, lead_group ORDER BY f) - 1 AS i FROM x), "
    "z AS (SELECT record_id, label, color FROM y JOIN palette USING (lead_group, i)) SELECT c.record_id, number, c.label, color FROM c LEFT JOIN z ON z.record_id = c.record_id AND z.label = c.label"
)
def palette_assignment(spark: SparkSession, d: str) -> DataFrame:
    return ch.with_colors(channels(spark, d)).select("record_id", "number", "label", "color")


_SURFACE_SQL = "regexp_replace(upper(label), '[_\\s-]', '', 'g') IN (" + ", ".join(map(_q, SURFACE)) + ")"


@query(
    f"WITH {_C}, x AS (SELECT record_id, count(*) AS n_leads, list_sort(list_distinct(list(label) FILTER (NOT {_SURFACE_SQL}))) AS u FROM c GROUP BY ALL) "
    "SELECT record_id, n_leads, CASE WHEN n_leads <> 12 THEN 'expected 12 leads, found ' || n_leads WHEN len(u) > 0 THEN 'unknown leads: ' || array_to_string(u, ', ') END AS warning FROM x"
)
def ecg_lead_validation(spark: SparkSession, d: str) -> DataFrame:
    return ch.ecg_warnings(channels(spark, d)).select("record_id", "n_leads", "warning")


@query(f"WITH {_C} SELECT record_id, number, label FROM c WHERE {_SURFACE_SQL}")
def surface_lead_select(spark: SparkSession, d: str) -> DataFrame:
    return ch.surface_leads(channels(spark, d)).select("record_id", "number", "label")


@query(f"WITH {_C}, {_LEADS} SELECT record_id, number, c.label, ord, CAST(row_number() OVER (PARTITION BY record_id ORDER BY ord, number) AS INTEGER) AS place FROM c JOIN leads ON c.label = leads.label")
def lead_order_sort(spark: SparkSession, d: str) -> DataFrame:
    from leadframe.functions.dims import lead_dim

    c = channels(spark, d).join(F.broadcast(lead_dim(spark)), "label")
    w = Window.partitionBy("record_id").orderBy("ord", "number")
    return c.select("record_id", "number", "label", "ord", F.row_number().over(w).alias("place"))


@query(f"WITH {_C}, {_LEADS} SELECT lead_group, count(*) AS channels, count(DISTINCT record_id) AS records FROM c LEFT JOIN leads ON c.label = leads.label GROUP BY ALL")
def source_tally(spark: SparkSession, d: str) -> DataFrame:
    c = ch.channel_source(channels(spark, d))
    return c.groupBy("lead_group").agg(F.count(F.lit(1)).alias("channels"), F.count_distinct("record_id").alias("records"))


@query(f"WITH {_C} SELECT DISTINCT {_STD} AS label FROM c WHERE label IS NOT NULL EXCEPT SELECT label FROM lead_dim")
def label_setdiff(spark: SparkSession, d: str) -> DataFrame:
    c = channels(spark, d).filter(F.col("label").isNotNull()).select(text.standard_label(F.col("label")).alias("label"))
    return c.subtract(table(spark, d, "lead_dim", "label"))


@query(
    f"WITH {_C}, n AS (SELECT record_id, count(*) AS channels FROM c GROUP BY ALL), {_A}, x AS (SELECT record_id, array_to_string(list_sort(list(DISTINCT annotator)), ',') AS annotators, count(*) AS marks FROM a GROUP BY ALL) "
    "SELECT r.record_id, r.vendor, r.frequency, round(r.samples / r.frequency, 6) AS duration_s, coalesce(n.channels, 0) AS channels, coalesce(x.annotators, '') AS annotators, coalesce(x.marks, 0) AS marks "
    "FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM records) r LEFT JOIN n USING (record_id) LEFT JOIN x USING (record_id)"
)
def recording_summary(spark: SparkSession, d: str) -> DataFrame:
    n = channels(spark, d).groupBy("record_id").agg(F.count(F.lit(1)).alias("channels"))
    a = annotations(spark, d).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("annotator")), ",").alias("annotators"), F.count(F.lit(1)).alias("marks"))
    r = records(spark, d).join(n, "record_id", "left").join(a, "record_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.select("record_id", "vendor", "frequency", F.round(F.col("samples") / F.col("frequency"), 6).alias("duration_s"), zero("channels"), F.coalesce("annotators", F.lit("")).alias("annotators"), zero("marks"))


# ---- along a channel -------------------------------------------------------------------------------------------------

_BY = "PARTITION BY record_id, label ORDER BY sample, mv"


@query(
    f"WITH {_G} SELECT record_id, label, count(mv) AS n, round(sqrt(avg(mv * mv)), 6) AS rms, round(avg(mv), 6) AS mean, round(stddev_samp(mv), 6) AS sd, round(avg(mv) + 0.5 * stddev_samp(mv), 6) AS qrs_threshold, "
    "round(3.5 * stddev_samp(mv), 6) AS entropy_tolerance, round(quantile_cont(mv, 0.99), 6) AS q99, round(min(mv), 6) AS least, round(max(mv), 6) AS greatest, round(avg(abs(mv)), 6) AS mean_abs FROM g GROUP BY ALL"
)
def channel_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = rhythm.channel_stats(readings(spark, d))
    return s.select("record_id", "label", "n", *(F.round(c, 6).alias(c) for c in s.columns[3:]))


@query(f"WITH {_G}, k AS (SELECT *, row_number() OVER (PARTITION BY record_id, label ORDER BY mv DESC, sample) AS k FROM g WHERE mv IS NOT NULL) SELECT record_id, label, sample, mv AS greatest FROM k WHERE k = 1")
def channel_argmax(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.argmax(readings(spark, d))


@query(f"WITH {_G}, k AS (SELECT *, row_number() OVER ({_BY}) AS k FROM g) SELECT record_id, label, sample FROM k WHERE k <= 50")
def first_samples(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.first_samples(readings(spark, d), 50).select("record_id", "label", "sample")


@query(f"WITH {_G}, k AS (SELECT *, lag(mv) OVER w AS p, lead(mv) OVER w AS n FROM g WINDOW w AS ({_BY})) SELECT record_id, label, sample FROM k WHERE mv > p AND mv > n")
def local_maxima_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.local_maxima(readings(spark, d)).select("record_id", "label", "sample")


@query(
    f"WITH {_G}, {_S}, k AS (SELECT record_id, label, sample, abs(mv) AS x, lag(abs(mv)) OVER w AS p, lead(abs(mv)) OVER w AS n FROM f WINDOW w AS (PARTITION BY record_id, label ORDER BY sample, mv)), "
    "l AS (SELECT record_id, label, avg(abs(mv)) + 2 * stddev_samp(abs(mv)) AS l FROM f GROUP BY ALL) SELECT record_id, label, sample FROM k JOIN l USING (record_id, label) WHERE x > p AND x > n AND x > l"
)
def find_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.find_peaks(readings(spark, d)).select("record_id", "label", "sample")


@query(
    f"WITH {_G}, {_S}, k AS (SELECT record_id, label, abs(mv) AS x, lag(abs(mv)) OVER w AS p, lead(abs(mv)) OVER w AS n FROM f WINDOW w AS (PARTITION BY record_id, label ORDER BY sample, mv)), "
    "l AS (SELECT record_id, label, avg(abs(mv)) + 2 * stddev_samp(abs(mv)) AS l FROM f GROUP BY ALL) SELECT record_id, label, count(*) AS peaks, round(avg(x), 9) AS mean_abs_peak FROM k JOIN l USING (record_id, label) WHERE x > p AND x > n AND x > l GROUP BY ALL"
)
def mean_abs_peak(spark: SparkSession, d: str) -> DataFrame:
    p = rhythm.find_peaks(readings(spark, d))
    return p.groupBy("record_id", "label").agg(F.count(F.lit(1)).alias("peaks"), F.round(F.avg(F.abs("mv")), 9).alias("mean_abs_peak"))


@query(
    f"WITH {_G}, {_S}, {_R} SELECT record_id, label, sample, round((-coalesce(mv, 0) - 2 * coalesce(lag(mv, 1) OVER w, 0) + 2 * coalesce(lag(mv, 3) OVER w, 0) + coalesce(lag(mv, 4) OVER w, 0)) * frequency / 8, 9) AS slope FROM f JOIN r USING (record_id) WINDOW w AS ({_BY})"
)
def derivative_fir(spark: SparkSession, d: str) -> DataFrame:
    s = rhythm.derivative(readings(spark, d).join(rates(spark, d), "record_id"))
    return s.select("record_id", "label", "sample", F.round("slope", 9).alias("slope"))


@query(
    f"WITH {_G}, {_S}, {_R}, n AS (SELECT f.*, CAST(greatest(round_even(0.15 * frequency, 0), 1) AS BIGINT) AS len, sum(coalesce(mv, 0)) OVER w AS upto, row_number() OVER w AS k FROM f JOIN r USING (record_id) WHERE frequency > 0 WINDOW w AS ({_BY} ROWS UNBOUNDED PRECEDING)) "
    "SELECT a.record_id, a.label, a.sample, round((a.upto - coalesce(b.upto, 0)) / a.len, 5) AS integral FROM n a LEFT JOIN n b ON a.record_id = b.record_id AND a.label = b.label AND b.k = a.k - a.len"
)
def moving_integration(spark: SparkSession, d: str) -> DataFrame:
    """Over 150 ms of each record's own rate."""
    s = rhythm.moving_integral_s(_rated(spark, d), "mv")
    return s.select("record_id", "label", "sample", F.round("integral", 5).alias("integral"))


_RISING = f"""{_G}, {_S}, k AS (SELECT *, lag(mv) OVER w AS p, lead(mv) OVER w AS n FROM f WINDOW w AS ({_BY})),
l AS (SELECT record_id, label, avg(mv) + 0.5 * stddev_samp(mv) AS l FROM f GROUP BY ALL), u AS (SELECT record_id, label, sample FROM k JOIN l USING (record_id, label) WHERE p < mv AND n > mv AND mv > l)"""


@query(f"WITH {_RISING} SELECT * FROM u")
def rising_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.rising(readings(spark, d)).select("record_id", "label", "sample")


@query(
    f"WITH RECURSIVE {_RISING}, t AS (SELECT record_id, label, min(sample) AS sample FROM u GROUP BY ALL UNION ALL (SELECT t.record_id, t.label, min(u.sample) FROM t JOIN u ON u.record_id = t.record_id AND u.label = t.label AND u.sample >= t.sample + 100 GROUP BY ALL)) SELECT * FROM t"
)
def refractory_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.apart(rising_threshold(spark, d), 100)


_BEATS_SQL = f"""{_A}, p AS (SELECT DISTINCT record_id, sample FROM a WHERE annotator = 'atr' AND type IN ('N', 'L', 'R', 'A', 'V', 'F', '/') AND sample IS NOT NULL),
i AS (SELECT record_id, sample, sample - lag(sample) OVER (PARTITION BY record_id ORDER BY sample) AS rr FROM p)"""


def _beats(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d, "atr")
    return a.filter(F.col("type").isin("N", "L", "R", "A", "V", "F", "/") & F.col("sample").isNotNull()).select("record_id", "sample").distinct()


@query(f"WITH {_BEATS_SQL} SELECT * FROM i")
def rr_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.intervals_between(_beats(spark, d))


@query(f"WITH {_BEATS_SQL}, m AS (SELECT record_id, median(rr) AS median_rr FROM i GROUP BY ALL) SELECT record_id, sample, rr, median_rr, coalesce(abs(rr - median_rr) > 0.4 * median_rr, false) AS is_aberrant FROM i JOIN m USING (record_id)")
def aberrant_beats(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.aberrant(_beats(spark, d))


@query(f"WITH {_G}, k AS (SELECT record_id, label, sample, mv AS v0, lead(mv, 1) OVER w AS v1, lead(mv, 2) OVER w AS v2, lead(sample, 2) OVER w AS s2 FROM g WINDOW w AS ({_BY})) SELECT * EXCLUDE (s2) FROM k WHERE s2 IS NOT NULL")
def embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.embedded(readings(spark, d)).select("record_id", "label", "sample", "v0", "v1", "v2")


@query(
    f"WITH {_G}, {_R}, s AS (SELECT record_id, label, frequency, list(mv ORDER BY sample, mv) AS v FROM g JOIN r USING (record_id) GROUP BY ALL), "
    "n AS (SELECT *, CAST(CASE WHEN frequency >= 1000 THEN len(v) ELSE floor(len(v) * 1000.0 / frequency) END AS BIGINT) AS m FROM s), p AS (SELECT *, i * (len(v) - 1) / CAST(m - 1 AS DOUBLE) AS x FROM n, unnest(range(0, m)) t(i)), "
    "q AS (SELECT *, greatest(least(CAST(floor(x) AS BIGINT), len(v) - 2), 0) AS k FROM p) SELECT record_id, label, CAST(i + 1 AS INTEGER) AS sample, round(v[k + 1] + CASE WHEN x > k THEN (x - k) * (v[k + 2] - v[k + 1]) ELSE 0 END, 9) AS mv FROM q"
)
def upsample_linear(spark: SparkSession, d: str) -> DataFrame:
    s = readings(spark, d).join(rates(spark, d), "record_id")
    return waveforms.upsampled(s, 1000.0).withColumn("mv", F.round("mv", 9))


# ---- features of whole channels --------------------------------------------------------------------------------------


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of 64 numbers as channels of 64 Hz."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.lit(64.0).alias("frequency"), F.posexplode("embedding").alias("sample", "x")).withColumn("mv", F.col("x").cast("double"))


@query(
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), t AS (SELECT vec_id, 3.5 * stddev_samp(v) * 0.2 AS r FROM e GROUP BY ALL),
w AS (SELECT vec_id, i, v AS a, lead(v, 1) OVER k AS b, lead(v, 2) OVER k AS c, lead(v, 3) OVER k AS d FROM e WINDOW k AS (PARTITION BY vec_id ORDER BY i)),
p AS (SELECT x.vec_id, x.i, count(*) FILTER (y.c IS NOT NULL AND x.c IS NOT NULL AND abs(x.a - y.a) <= 1.0 AND abs(x.b - y.b) <= 1.0 AND abs(x.c - y.c) <= 1.0) AS n3,
  count(*) FILTER (y.d IS NOT NULL AND x.d IS NOT NULL AND abs(x.a - y.a) <= 1.0 AND abs(x.b - y.b) <= 1.0 AND abs(x.c - y.c) <= 1.0 AND abs(x.d - y.d) <= 1.0) AS n4
  FROM w x JOIN w y USING (vec_id) GROUP BY ALL)
SELECT vec_id, round(avg(ln(n3 / 62.0)) FILTER (n3 > 0) - avg(ln(n4 / 61.0)) FILTER (n4 > 0), 6) AS approximate_entropy FROM p GROUP BY ALL"""
)
def approx_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = waveforms.approximate_entropy(_arrays(spark, d), 3, 1.0, keys=("vec_id",))
    return e.withColumn("approximate_entropy", F.round("approximate_entropy", 6))


_PLACED = f"""{_G}, {_S}, x AS (SELECT record_id, label, coalesce(mv, 0) AS v, row_number() OVER ({_BY}) - 1 AS i, count(*) OVER (PARTITION BY record_id, label) AS n FROM f)"""


@query(
    f"""WITH {_PLACED}, t AS (SELECT record_id, label, 3.5 * stddev_samp(v) AS r FROM x GROUP BY ALL),
w AS (SELECT x.record_id, x.label, i, n, r, v AS a, lead(v, 1) OVER k AS b, lead(v, 2) OVER k AS c, lead(v, 3) OVER k AS d FROM x JOIN t USING (record_id, label) WHERE n > 3 WINDOW k AS (PARTITION BY x.record_id, x.label ORDER BY i)),
p AS (SELECT x.record_id, x.label, x.i, any_value(x.n) AS n, count(*) AS n3, count(*) FILTER (abs(x.d - y.d) <= x.r) AS n4
  FROM w x JOIN w y ON x.record_id = y.record_id AND x.label = y.label AND abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r AND abs(x.c - y.c) <= x.r GROUP BY x.record_id, x.label, x.i)
SELECT record_id, label, round(avg(ln(n3 / (n - 2))) - avg(ln(n4 / (n - 3))) FILTER (n4 > 0), 9) AS approximate_entropy FROM p GROUP BY ALL
UNION ALL SELECT DISTINCT record_id, label, NULL FROM x WHERE n <= 3"""
)
def approx_entropy_channels(spark: SparkSession, d: str) -> DataFrame:
    """Every whole channel, with the default tolerance."""
    return waveforms.approximate_entropy(delivered(spark, d)).withColumn("approximate_entropy", F.round("approximate_entropy", 9))


@query(
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
l AS (SELECT vec_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM e GROUP BY ALL),
t AS (SELECT vec_id, i, (v - a - b * i) * CASE WHEN i < 6 THEN 0.5 * (1 - cos(pi() * (2 * i + 1) / 12)) WHEN i > 57 THEN 0.5 * (1 - cos(pi() * (2 * (63 - i) + 1) / 12)) ELSE 1 END AS x FROM e JOIN l USING (vec_id)),
p AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2) AS power FROM t, unnest(range(4, 10)) u(k) GROUP BY ALL)
SELECT vec_id, CAST(arg_max(k, power) AS DOUBLE) AS dominant_frequency FROM p GROUP BY ALL"""
)
def dominant_frequency_arrays(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.dominant_frequency(_arrays(spark, d), 4.0, 9.0, keys=("vec_id",))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).join(rates(spark, d), "record_id")


@query(
    f"""WITH {_PLACED}, {_R}, q AS (SELECT x.*, frequency FROM x JOIN r USING (record_id) WHERE n >= 4),
l AS (SELECT record_id, label, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM q GROUP BY ALL),
t AS (SELECT record_id, label, frequency, n, i, CAST(floor(n * 0.1) AS BIGINT) AS k, least(i, n - 1 - i) AS e, (v - a - b * i) * CASE WHEN e < k THEN 0.5 * (1 - cos(pi() * (2 * e + 1) / (2 * k))) ELSE 1 END AS v FROM q JOIN l USING (record_id, label)),
smooth AS (SELECT pow(2, a) * pow(3, b) * pow(5, c) AS m FROM range(0, 31) x(a), range(0, 20) y(b), range(0, 14) z(c)),
z AS (SELECT record_id, label, frequency, n, (SELECT min(m) FROM smooth WHERE m >= n) AS size FROM (SELECT DISTINCT record_id, label, frequency, n FROM t)),
f2 AS (SELECT z.*, k AS bin, k * frequency / size AS hz FROM z, unnest(range(CAST(ceil(4 * size / frequency) AS BIGINT), CAST(least(floor(9 * size / frequency), floor(size / 2)) AS BIGINT) + 1)) u(k)),
p AS (SELECT f2.record_id, f2.label, hz, bin, pow(sum(v * cos(2 * pi() * ((bin * i) % size) / size)), 2) + pow(sum(v * sin(2 * pi() * ((bin * i) % size) / size)), 2) AS power FROM f2 JOIN t USING (record_id, label) GROUP BY ALL)
SELECT record_id, label, round(arg_max(hz, power), 9) AS dominant_frequency FROM p GROUP BY ALL
UNION ALL SELECT DISTINCT x.record_id, x.label, NULL FROM x JOIN r USING (record_id) WHERE (x.record_id, x.label) NOT IN (SELECT (record_id, label) FROM f2)"""
)
def dominant_frequency(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.dominant_frequency(_rated(spark, d)).withColumn("dominant_frequency", F.round("dominant_frequency", 9))


def _bandpass_sql(order: int, low: float, high: float) -> str:
    """Zero-phase Butterworth band pass of every channel, step by step: ``y`` has (record_id, label, frequency, i, y).

    Poles from the analogue prototype by the bilinear transform, all sections in one row per step; forward over the
    channel and zeros of two filter lengths, then backward.
    """
    k = range(1, order + 1)
    tail = 2 * (2 * order + 1)

    def steps(name: str, source: str, signal: str) -> str:
        zero = ", ".join(f"0.0::DOUBLE AS p{j}, 0.0::DOUBLE AS q{j}" for j in k)
        run, into = [], "x"
        for j in k:
            run.append(f"g * {into} + p{j} AS y{j}, q{j} - a{j} * y{j} AS p{j}n, -g * {into} - b{j} * y{j} AS q{j}n")
            into = f"y{j}"
        state = ", ".join(f"p{j}n, q{j}n" for j in k)
        return f"""{name} AS (SELECT record_id, label, 0::BIGINT AS i, 0.0::DOUBLE AS y, {zero} FROM {source}
  UNION ALL SELECT record_id, label, i, y{order}, {state} FROM (SELECT record_id, label, i, {", ".join(run)} FROM
    (SELECT w.record_id, w.label, w.i + 1 AS i, {signal}[w.i + 1] AS x, {", ".join(f"p{j}, q{j}, a{j}, b{j}" for j in k)}, g FROM {name} w JOIN {source} s USING (record_id, label) JOIN sections USING (frequency) WHERE w.i < len({signal}))))"""

    return f"""{_G}, {_S}, {_R}, listed AS (SELECT record_id, label, frequency, list(coalesce(mv, 0) ORDER BY sample, mv) || list_transform(range(0, {tail}), lambda z: 0.0::DOUBLE) AS v, count(*) AS n FROM f JOIN r USING (record_id) WHERE frequency > {2 * high} GROUP BY ALL),
warped AS (SELECT frequency, 2 * tan(pi() * {low} / frequency) AS w1, 2 * tan(pi() * {high} / frequency) AS w2 FROM (SELECT DISTINCT frequency FROM listed)),
proto AS (SELECT frequency, w1 * w2 AS c, w2 - w1 AS width, k, cos(pi() * (2 * k + {order - 1}) / {2 * order}) * (w2 - w1) / 2 AS hr, sin(pi() * (2 * k + {order - 1}) / {2 * order}) * (w2 - w1) / 2 AS hi FROM warped, unnest(range(1, {order + 1})) u(k)),
roots AS (SELECT *, hr * hr - hi * hi - c AS dr, 2 * hr * hi AS di, sqrt(dr * dr + di * di) AS size, sqrt((size + dr) / 2) AS rr, CASE WHEN di < 0 THEN -1 ELSE 1 END * sqrt(greatest(size - dr, 0) / 2) AS ri FROM proto),
poles AS (SELECT frequency, width, k, hi, sign, hr + sign * rr AS sr, hi + sign * ri AS si, (2 - sr) * (2 - sr) + si * si AS d, (4 - sr * sr - si * si) / d AS zr, 4 * si / d AS zi FROM roots, unnest([1, -1]) u(sign)),
gains AS (SELECT frequency, any_value(width) AS width, exp((sum(ln(2 * width)) / 2 - sum(ln(d)) / 2) / {order}) AS g FROM poles GROUP BY frequency),
pairs AS (SELECT frequency, k, sign, -2 * zr AS a, zr * zr + zi * zi AS b FROM poles WHERE hi > 1e-9 * width
  UNION ALL SELECT p.frequency, p.k, 0, -(p.zr + q.zr), p.zr * q.zr - p.zi * q.zi FROM poles p JOIN poles q ON p.frequency = q.frequency AND p.k = q.k AND p.sign = 1 AND q.sign = -1 WHERE abs(p.hi) <= 1e-9 * p.width),
numbered AS (SELECT *, row_number() OVER (PARTITION BY frequency ORDER BY k, sign) AS j FROM pairs),
sections AS (SELECT frequency, any_value(g) AS g, {", ".join(f"max(a) FILTER (j = {j}) AS a{j}, max(b) FILTER (j = {j}) AS b{j}" for j in k)} FROM numbered JOIN gains USING (frequency) GROUP BY frequency),
{steps("ahead", "listed", "s.v")},
turned AS (SELECT record_id, label, frequency, n, list(y ORDER BY i DESC) AS b FROM ahead JOIN listed USING (record_id, label) WHERE i > 0 GROUP BY ALL),
{steps("back", "turned", "s.b")},
y AS (SELECT record_id, label, frequency, n, n + {tail} + 1 - back.i AS i, back.y FROM back JOIN turned USING (record_id, label) WHERE back.i > {tail})"""


@query(
    f"""WITH RECURSIVE {_bandpass_sql(4, 5.0, 15.0)},
slopes AS (SELECT record_id, label, frequency, n, i, y + 2 * coalesce(lag(y, 1) OVER w, 0) - 2 * coalesce(lag(y, 3) OVER w, 0) - coalesce(lag(y, 4) OVER w, 0) AS d FROM y WINDOW w AS (PARTITION BY record_id, label ORDER BY i)),
power AS (SELECT *, pow(d * frequency / 8, 2) AS p, CAST(greatest(round_even(0.15 * frequency, 0), 1) AS BIGINT) AS len FROM slopes),
total AS (SELECT *, sum(p) OVER (PARTITION BY record_id, label ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM power),
energy AS (SELECT a.record_id, a.label, a.frequency, a.i, (a.upto - coalesce(b.upto, 0)) / a.len AS e FROM total a LEFT JOIN total b ON a.record_id = b.record_id AND a.label = b.label AND b.i = a.i - a.len WHERE a.n >= 8 AND a.frequency > 30),
level AS (SELECT record_id, label, avg(e) + 0.5 * stddev_samp(e) AS level FROM energy GROUP BY ALL),
steep AS (SELECT record_id, label, frequency, i, e, lag(e) OVER w AS before, lead(e) OVER w AS after FROM energy WINDOW w AS (PARTITION BY record_id, label ORDER BY i)),
peaks AS (SELECT record_id, label, i, CAST(round_even(0.2 * frequency, 0) AS BIGINT) AS rest FROM steep JOIN level USING (record_id, label) WHERE before < e AND e < after AND e > level),
taken AS (SELECT record_id, label, min(i) AS sample FROM peaks GROUP BY ALL UNION ALL (SELECT t.record_id, t.label, min(p.i) FROM taken t JOIN peaks p ON t.record_id = p.record_id AND t.label = p.label AND p.i > t.sample + p.rest GROUP BY ALL))
SELECT record_id, label, CAST(sample AS INTEGER) AS sample FROM taken"""
)
def detect_qrs(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.qrs(_rated(spark, d))


@query(f"WITH RECURSIVE {_bandpass_sql(3, 0.5, 30.0)} SELECT record_id, label, CAST(i AS INTEGER) AS sample, round(y, 4) AS filtered FROM y")
def bandpass_filter(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.filtered(_rated(spark, d)).withColumn("filtered", F.round("filtered", 4))


def _surface(spark: SparkSession, d: str) -> DataFrame:
    """Readings of surface leads, however their names are written."""
    return ch.surface_leads(_rated(spark, d))


@query()
def f_wave_features(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.f_waves(_surface(spark, d), ("amplitude", "approximate_entropy", "dominant_frequency"))


@query()
def f_wave_features_ica(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.f_waves(_surface(spark, d), ("amplitude", "approximate_entropy", "dominant_frequency"), "ica")
