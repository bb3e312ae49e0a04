"""Queries of the general data problems (p2, p3, p5, p6, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.operators import intervals, parsing, spikes, timestamps, units
from leadframe.sources.tables import table

def _wave_intervals(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "annotation_table", "record_id", "annotator", "sample", "type", "number")
    return intervals.pair_bounds(marks.filter(F.col("annotator") == "ecgpuwave"), ["record_id", "number"], "sample", "type")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(_wave_intervals(spark, d), ["record_id"])


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(_wave_intervals(spark, d), ["record_id"])


_INTERVALS_SQL = """
m AS (SELECT DISTINCT record_id, number, sample, type FROM annotation_table
      WHERE annotator = 'ecgpuwave' AND type IN ('(', ')') AND record_id IS NOT NULL AND number IS NOT NULL AND sample IS NOT NULL),
p AS (SELECT *, min(CASE WHEN type = ')' THEN sample END) OVER (PARTITION BY record_id, number ORDER BY sample
             RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM m),
i AS (SELECT DISTINCT record_id, sample AS start, stop FROM p WHERE type = '(' AND stop IS NOT NULL),
r AS (SELECT *, max(stop) OVER (PARTITION BY record_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_stop FROM i)
"""

P2_FOUND_SQL = f"WITH {_INTERVALS_SQL} SELECT record_id, prev_stop AS gap_from, start AS gap_to FROM r WHERE start > prev_stop"

P2_PERIODS_SQL = f"""WITH {_INTERVALS_SQL},
l AS (SELECT *, sum(CASE WHEN prev_stop IS NULL OR start > prev_stop THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY start, stop
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r)
SELECT record_id, min(start) AS period_from, max(stop) AS period_to, count(*) AS n_intervals FROM l GROUP BY record_id, island"""


_LOGS = (("bard", ","), ("prucka", ";"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [parsing.rejected(table(spark, d, log), parsing.header_log(sep)) for log, sep in _LOGS]
    return parts[0].unionByName(parts[1])


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    parts = [parsing.strict_load(table(spark, d, log), parsing.header_log(sep)).withColumn("log", F.lit(log)) for log, sep in _LOGS]
    return parts[0].unionByName(parts[1]).withColumn("samples", F.col("samples").try_cast("bigint"))


def _lines_sql(log: str, s: str) -> str:
    f = f'("([^"]|"")*"|[^"{s}]*)'
    return f"""SELECT raw_id, '{log}' AS log, coalesce(raw_text, '') AS t,
  regexp_full_match(coalesce(raw_text, ''), '(?s){f}({s}{f})*') AS sound,
  list_transform(regexp_extract_all('{s}' || coalesce(raw_text, ''), '(?s){s}("(?:[^"]|"")*"|[^"{s}]*)', 1),
    lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ' || chr(9))) AS f
  FROM {log}"""


_P3_SQL = f"""WITH x AS ({_lines_sql("bard", ",")} UNION ALL {_lines_sql("prucka", ";")}),
y AS (SELECT DISTINCT *, sound AND len(f) = 6 AND regexp_full_match(f[2], '0*([1-9]|[1-9][0-9]|[1-4][0-9][0-9]|50[0-9]|51[0-2])')
  AND regexp_full_match(f[3], '[0-9]*[1-9][0-9]*( [0-9][0-9]:[0-5][0-9]:[0-5][0-9])?')
  AND regexp_full_match(f[4], '[0-9]+([.][0-9]+)? ?(Hz|points/second)?') AND regexp_matches(f[4], '^[0-9.]*[1-9]') AS fine FROM x)"""

P3_FOUND_SQL = f"""{_P3_SQL} SELECT raw_id, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> 6 THEN 'columns' ELSE 'value' END AS reason
FROM y WHERE NOT fine"""

P3_LOADED_SQL = f"""{_P3_SQL} SELECT raw_id, log, f[1] AS record_name, CAST(f[2] AS INTEGER) AS channels,
TRY_CAST(regexp_extract(f[3], '^[0-9]+') AS BIGINT) AS samples, regexp_replace(regexp_extract(f[3], '^[0-9]+'), '^0+', '') AS samples_text, CAST(regexp_extract(f[4], '^[0-9.]+') AS DOUBLE) AS rate, f[5] AS start, f[6] AS note
FROM y WHERE fine"""


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    """Clock texts of header and annotation rows with their source and its record order."""
    site = table(spark, d, "records", "record_id", "vendor", "site_id").distinct().join(table(spark, d, "sites", "site_id", "tz_name"), "site_id", "left")
    heads = (
        table(spark, d, "header_table", "record_id", "start_time", "loaded_at")
        .filter(F.col("start_time").isNotNull())
        .groupBy("record_id", "start_time")
        .agg(F.min(F.unix_seconds("loaded_at")).alias("ord"))
        .join(site, "record_id", "left")
        .select(
            F.concat(F.lit("h:"), "record_id").alias("row_key"),
            F.concat_ws(":", F.lit("h"), F.col("vendor"), F.col("site_id").cast("string")).alias("source"),
            "ord", F.col("start_time").alias("text"), "tz_name",
        )
    )
    marks = (
        table(spark, d, "annotation_table", "ann_id", "record_id", "annotator", "time")
        .filter(F.col("time").rlike(r"\d{4}"))  # elapsed times have no year
        .distinct()
        .join(site, "record_id", "left")
        .select(
            F.concat(F.lit("a:"), F.col("ann_id").cast("string")).alias("row_key"),
            F.concat_ws(":", F.lit("a"), F.col("record_id"), F.col("annotator")).alias("source"),
            F.col("ann_id").alias("ord"), F.col("time").alias("text"), "tz_name",
        )
    )
    return heads.unionByName(marks)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """By the stated conventions, which leave nothing for the order of records to decide."""
    read = timestamps.stated(_stamps(spark, d), "text", "tz_name")
    return read.select(F.col("row_key").alias("stamp_key"), "utc_ms").distinct()


def p5_order(spark: SparkSession, d: str) -> DataFrame:
    """The same without stated conventions: formats and directions are told by the order of records alone."""
    read = timestamps.readings(_stamps(spark, d), "text", "tz_name", convention_cost=0.0)
    return timestamps.choose(read, timestamps.Costs(convention=0.0)).select(F.col("row_key").alias("stamp_key"), "utc_ms").distinct()


_STAMP_SQL = r"""
WITH site AS (SELECT DISTINCT r.record_id, s.tz_name FROM records r LEFT JOIN sites s USING (site_id)),
raw AS (SELECT DISTINCT 'h:' || record_id AS stamp_key, record_id, start_time AS t FROM header_table WHERE start_time IS NOT NULL
  UNION SELECT DISTINCT 'a:' || ann_id, record_id, time FROM annotation_table WHERE time IS NOT NULL),
c AS (SELECT stamp_key, tz_name, trim(regexp_replace(t, '[\s\[\]()  ]+', ' ', 'g')) AS t FROM raw LEFT JOIN site USING (record_id)),
k AS (SELECT *, regexp_extract(t, '(\d{1,2}):(\d\d)(:(\d\d)([.]\d+)?)?', 0) AS clock,
  CASE WHEN regexp_full_match(t, '\d{9,18}') THEN 'n' WHEN regexp_matches(t, '^\d{4}-\d\d?-\d\d?[T ]\d') THEN 'i' WHEN regexp_matches(t, '^\d{8}T\d{6}') THEN 'c'
    WHEN regexp_matches(t, '^\d\d?[- ][A-Za-z]{3,9}[- ]\d{4} ') THEN 'm' WHEN regexp_matches(t, '^\d\d?[/-]\d\d?[/-]\d{4} ') THEN 'u' WHEN regexp_matches(t, ' \d\d?/\d\d?/\d{4}$') THEN 'd' END AS kind FROM c),
w AS (SELECT *, CASE kind WHEN 'i' THEN try_strptime(replace(substr(regexp_extract(t, '^[0-9T :.-]{19}'), 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')
    WHEN 'c' THEN try_strptime(substr(t, 1, 15), '%Y%m%dT%H%M%S') WHEN 'd' THEN try_strptime(regexp_extract(t, '^\d\d?:\d\d:\d\d') || regexp_extract(t, ' \d\d?/\d\d?/\d{4}$'), '%H:%M:%S %d/%m/%Y')
    WHEN 'm' THEN try_strptime(replace(regexp_extract(t, '^\d\d?[- ][A-Za-z]{3}[- ]\d{4} \d\d?:\d\d:\d\d'), '-', ' '), '%d %b %Y %H:%M:%S')
    WHEN 'u' THEN try_strptime(replace(t, '-', '/'), ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M:%S']) END AS local,
  coalesce(CAST(rpad(nullif(regexp_extract(t, ':\d\d[.](\d{1,3})', 1), ''), 3, '0') AS BIGINT), 0) AS ms,
  CASE WHEN kind IN ('i', 'c', 'm') THEN regexp_extract(substr(t, 12), '(Z|GMT|UTC|[+-]\d\d:?\d\d)$', 1) ELSE '' END AS off FROM k),
v AS (SELECT *, epoch_ms(local) AS l, (local AT TIME ZONE tz_name) AS u FROM w),
o AS (SELECT *, CASE WHEN (u - INTERVAL 1 HOUR) AT TIME ZONE tz_name = local THEN epoch_ms(u - INTERVAL 1 HOUR) ELSE epoch_ms(u) END AS at_site FROM v)
SELECT DISTINCT stamp_key, utc_ms FROM (
  SELECT stamp_key, CASE WHEN kind = 'n' THEN CASE WHEN length(t) <= 11 THEN CAST(t AS BIGINT) * 1000 WHEN length(t) <= 14 THEN CAST(t AS BIGINT) ELSE CAST(t AS BIGINT) // 1000 END
    WHEN off IN ('Z', 'GMT', 'UTC') THEN l + ms
    WHEN off <> '' THEN l + ms - (CASE WHEN off LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(off, 2, 2) AS BIGINT) * 60 + CAST(right(off, 2) AS BIGINT)) * 60000
    ELSE at_site + ms END AS utc_ms FROM o) WHERE utc_ms IS NOT NULL"""

P5_FOUND_SQL = _STAMP_SQL


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ggm", "record_id", "label", "sample", "mv")
    return spikes.implausible(g, ["record_id", "label"], "sample", "mv").select("record_id", "label", "sample").distinct()


def p6_hampel(spark: SparkSession, d: str) -> DataFrame:
    """Every reading that the Hampel filter objects to, with production settings."""
    g = table(spark, d, "ggm", "record_id", "label", "sample", "mv")
    return spikes.scan(g, ["record_id", "label"], "sample", "mv").filter("hampel").select("record_id", "label", "sample").distinct()


P6_HAMPEL_SQL = """WITH g AS (SELECT DISTINCT record_id, label, sample, mv FROM ggm WHERE mv IS NOT NULL),
w AS (SELECT record_id, label, sample, mv, list(CASE WHEN isfinite(mv) THEN mv END) OVER (PARTITION BY record_id, label ORDER BY sample, mv ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS v FROM g),
m AS (SELECT *, list_median(list_filter(v, lambda a: a IS NOT NULL)) AS med FROM w)
SELECT DISTINCT record_id, label, sample FROM m WHERE isfinite(mv) AND abs(mv - med) > 3 * 1.4826 * list_median(list_transform(list_filter(v, lambda a: a IS NOT NULL), lambda a: abs(a - med)))"""


def _isolation_sql() -> str:
    """The largest least distance over the runs of up to three readings that a reading is in."""
    at = lambda k: "mv" if k == 0 else f"lag(mv, {-k}) OVER w" if k < 0 else f"lead(mv, {k}) OVER w"
    runs = []
    for length in (1, 2, 3):
        for place in range(length):
            before, after = at(-place - 1), at(length - place)
            each = [f"CASE WHEN isnan(({at(k)}) - ({x})) THEN 0 ELSE abs(({at(k)}) - ({x})) END" for k in range(-place, length - place) for x in (before, after)]
            runs.append(f"CASE WHEN ({before}) IS NULL OR ({after}) IS NULL THEN 0 ELSE least({', '.join(each)}) END")
    return f"greatest({', '.join(runs)})"


def _p6_sql(rounds: int = 5) -> str:
    """Spans are refined from robust ones: each round leaves out what the last one calls a spike."""
    steps = ["s0 AS (SELECT record_id, label, quantile_cont(mv, 0.9) - quantile_cont(mv, 0.1) AS span FROM x WHERE NOT bad GROUP BY ALL)"]
    for k in range(rounds):
        steps.append(f"s{k + 1} AS (SELECT record_id, label, max(mv) - min(mv) AS span FROM x JOIN s{k} s USING (record_id, label) WHERE NOT bad AND iso <= 1.5 * s.span GROUP BY ALL)")
    return f"""WITH g AS (SELECT DISTINCT record_id, label, sample, mv FROM ggm WHERE mv IS NOT NULL),
i AS (SELECT *, {_isolation_sql()} AS iso, NOT isfinite(mv) OR abs(mv) > 50 AS impossible, row_number() OVER w - row_number() OVER (PARTITION BY record_id, label, mv ORDER BY sample) AS run
  FROM g WINDOW w AS (PARTITION BY record_id, label ORDER BY sample)),
x AS (SELECT *, impossible OR count(*) OVER (PARTITION BY record_id, label, mv, run) >= 20 AS bad FROM i),
{", ".join(steps)}
SELECT DISTINCT record_id, label, sample FROM x LEFT JOIN s{rounds} s USING (record_id, label) WHERE bad OR iso > 1.5 * s.span"""


P6_FOUND_SQL = _p6_sql()


def _channels(spark: SparkSession, d: str) -> DataFrame:
    cols = ("record_id", "number", "adc_gain", "adc_units", "info_text", "adc_saturation", "range_text")
    return table(spark, d, "header_table", *cols).distinct()


def p7_scales(spark: SparkSession, d: str) -> DataFrame:
    s = units.counts_per_mv(_channels(spark, d))
    return s.select("record_id", "number", F.round(F.col("scale_mv") * 1000).cast("bigint").alias("gain_milli"), "basis", "uncertain").distinct()


def p7_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Channels that state no unit, by the mixture alone: no convention says what a missing unit is."""
    s = units.counts_per_mv(_channels(spark, d), default=None).filter(F.col("basis") == "fitted")
    return s.select("record_id", "number", "unit", F.round(F.col("scale_mv") * 1000).cast("bigint").alias("gain_milli")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = units.counts_per_mv(_channels(spark, d)).filter(F.col("scale_mv").isNotNull())
    already = (F.col("basis") != "range") & (F.col("unit") == "mV") & ~F.col("inverse")
    return s.filter(~already).select("record_id", "number", F.round(F.col("scale_mv") * 1000).cast("bigint").alias("gain_milli")).distinct()


_P7_SQL = r"""
WITH h AS (SELECT DISTINCT record_id, number, adc_gain, adc_saturation, lower(translate(trim(coalesce(adc_units, '')), 'µμ', 'uu')) AS u,
    lower(translate(coalesce(info_text, ''), 'µμé', 'uue')) AS i, lower(translate(coalesce(range_text, ''), 'µμ', 'uu')) AS r FROM header_table),
n AS (SELECT *, regexp_matches(u, '(/| per )(bit|count|lsb)$') AS inverse, regexp_replace(u, ' ?(/|per) ?(bit|count|lsb)$', '') AS un,
    CASE WHEN regexp_matches(i, '(unit|einheit|amplitude|exported|export|values|traces|scale)') AND NOT regexp_matches(i, '(noise|pulse|battery)')
      THEN regexp_extract(i, '(^|[^a-z])((milli|micro|nano)? ?volts?|[mun]?v)([^a-z]|$)', 2) ELSE '' END AS said_, trim(said_) AS said,
    regexp_extract(r, '([0-9.]+) ?([a-z]+)$', 1) AS rv, regexp_extract(r, '([0-9.]+) ?([a-z]+)$', 2) AS ru FROM h),
m AS (SELECT * FROM (VALUES ('v', 0.001), ('volt', 0.001), ('volts', 0.001), ('mv', 1.0), ('millivolt', 1.0), ('millivolts', 1.0), ('uv', 1000.0), ('microvolt', 1000.0),
    ('microvolts', 1000.0), ('micro volt', 1000.0), ('nv', 1000000.0), ('nanovolt', 1000000.0), ('nanovolts', 1000000.0)) t(name, per)),
s AS (SELECT n.*, un IN ('', '-', 'adu') AS nameless, m1.per AS p1, m2.per AS p2, m3.per AS p3 FROM n LEFT JOIN m m1 ON un = m1.name LEFT JOIN m m2 ON said = m2.name LEFT JOIN m m3 ON ru = m3.name),
x AS (SELECT *, CASE WHEN nameless THEN coalesce(p2, 1.0) ELSE p1 END AS per, CASE WHEN NOT nameless AND p1 IS NULL THEN NULL WHEN p3 IS NOT NULL AND adc_saturation > 0 THEN adc_saturation / (CAST(rv AS DOUBLE) / p3) END AS by_range FROM s),
y AS (SELECT *, CASE WHEN by_range IS NOT NULL THEN by_range WHEN adc_gain > 0 AND NOT isnan(adc_gain) THEN (CASE WHEN inverse AND NOT nameless THEN 1 / adc_gain ELSE adc_gain END) * per END AS scale FROM x)
"""

P7_FOUND_SQL = f"""{_P7_SQL} SELECT DISTINCT record_id, number, CAST(round(CAST(scale AS DOUBLE) * 1000) AS BIGINT) AS gain_milli FROM y
WHERE scale IS NOT NULL AND (by_range IS NOT NULL OR per <> 1.0 OR (inverse AND NOT nameless))"""


P7_FITTED_SQL = f"""{_P7_SQL} SELECT DISTINCT record_id, number, 'mV' AS unit, CAST(round(adc_gain * 1000) AS BIGINT) AS gain_milli FROM y
WHERE nameless AND p2 IS NULL AND by_range IS NULL AND adc_gain > 0 AND isfinite(adc_gain)"""

P7_SCALES_SQL = f"""{_P7_SQL} SELECT DISTINCT record_id, number, CAST(round(CAST(scale AS DOUBLE) * 1000) AS BIGINT) AS gain_milli,
CASE WHEN by_range IS NOT NULL THEN 'range' WHEN scale IS NULL THEN NULL WHEN nameless AND p2 IS NULL THEN 'fitted' ELSE 'stated' END AS basis, false AS uncertain FROM y"""

QUERIES = {
    "p2_found": p2_found, "p2_periods": p2_periods, "p3_found": p3_found, "p3_loaded": p3_loaded, "p5_found": p5_found, "p5_order": p5_order,
    "p6_found": p6_found, "p6_hampel": p6_hampel, "p7_found": p7_found, "p7_scales": p7_scales, "p7_fitted": p7_fitted,
}

SQL = {
    "p2_found": P2_FOUND_SQL, "p2_periods": P2_PERIODS_SQL, "p3_found": P3_FOUND_SQL, "p3_loaded": P3_LOADED_SQL, "p5_found": P5_FOUND_SQL, "p5_order": P5_FOUND_SQL,
    "p6_found": P6_FOUND_SQL, "p6_hampel": P6_HAMPEL_SQL, "p7_found": P7_FOUND_SQL, "p7_fitted": P7_FITTED_SQL, "p7_scales": P7_SCALES_SQL,
}
