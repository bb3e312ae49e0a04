"""Queries of the training-data problems (p1, p4, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.llm import canonical, leakage, mixing, nearest, pii
from leadframe.operators import channels as ch
from leadframe.plans import signals
from leadframe.sources.tables import table

# Annotation codes that mark a beat.
BEATS = ("N", "L", "R", "A", "V", "F", "/")
TOLERANCE_MS = 150
RANGE_S = 600


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of manual and automatic marks of one beat, smaller ann_id first."""
    rate = table(spark, d, "records", "record_id", "frequency").filter(F.col("frequency") > 0).distinct()
    marks = table(spark, d, "annotation_table", "ann_id", "record_id", "annotator", "sample", "type").filter(F.col("type").isin(*BEATS)).join(rate, "record_id")
    pairs = nearest.match_nearest(
        marks.filter(F.col("annotator") == "atr"), marks.filter(F.col("annotator") == "qrs"), "record_id", "sample", "ann_id",
        tolerance=F.col("frequency") * TOLERANCE_MS / 1000, width=F.col("frequency") * RANGE_S,
    )
    return pairs.select(F.least("left_key", "right_key").alias("ann_id_a"), F.greatest("left_key", "right_key").alias("ann_id_b")).distinct()


P1_FOUND_SQL = """
WITH m AS (SELECT DISTINCT a.ann_id, a.record_id, a.annotator, a.sample, r.frequency FROM annotation_table a
  JOIN (SELECT DISTINCT record_id, frequency FROM records WHERE frequency > 0) r USING (record_id)
  WHERE a.annotator IN ('atr', 'qrs') AND a.type IN ('N', 'L', 'R', 'A', 'V', 'F', '/') AND a.sample IS NOT NULL),
b AS (SELECT x.ann_id, y.ann_id AS other, x.annotator, abs(x.sample - y.sample) AS dist, x.frequency,
  row_number() OVER (PARTITION BY x.ann_id ORDER BY abs(x.sample - y.sample), y.sample, y.ann_id) AS k
  FROM m x JOIN m y ON x.record_id = y.record_id AND x.annotator <> y.annotator AND abs(x.sample - y.sample) * 1000 <= 150 * x.frequency)
SELECT least(x.ann_id, y.ann_id) AS ann_id_a, greatest(x.ann_id, y.ann_id) AS ann_id_b
FROM b x JOIN b y ON x.other = y.ann_id AND y.other = x.ann_id WHERE x.k = 1 AND y.k = 1 AND x.annotator = 'atr'"""


def _label_map(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Channels whose label is typed otherwise than in the list, and what each typed label means."""
    leads = table(spark, d, "lead_dim", "label_id", "label", "long_name")
    typed = table(spark, d, "header_table", "record_id", "number", "label").filter(F.trim("label") != "").distinct()
    typed = typed.join(leads.select("label"), "label", "left_anti")
    return typed, canonical.map_to_reference(typed, "label", leads, "label_id", "label", canonical.CHANNEL_WORDS, canonical.CHANNEL_NAMES, long_text="long_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed, meant = _label_map(spark, d)
    both = typed.join(meant.withColumnRenamed("value", "label"), "label")
    return both.select("record_id", "number", F.coalesce("label_id", F.lit(0)).cast("int").alias("label_id")).distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed labels that mean no entry, with the number of channels that have them."""
    typed, meant = _label_map(spark, d)
    none = meant.filter(F.col("label_id").isNull()).select(F.col("value").alias("label"))
    return typed.join(none, "label").groupBy("label").agg(F.count(F.lit(1)).alias("channels"))


def _scales(spark: SparkSession, d: str) -> DataFrame:
    """Gain, baseline and format per channel, under the canonical label that a typed one means."""
    _, meant = _label_map(spark, d)
    known = meant.join(table(spark, d, "lead_dim", "label_id", F.col("label").alias("canonical")), "label_id")
    return ch.scales(signals.channels(spark, d), known.select(F.col("value").alias("label"), "canonical"))


def digital_to_physical_all(spark: SparkSession, d: str) -> DataFrame:
    """Every converter count in mV; a channel that no header label means has the default gain."""
    s = signals.counts(spark, d).join(_scales(spark, d), ["record_id", "label"], "left")
    return s.select("record_id", "sample", "label", F.round(ch.to_physical(F.col("value"), F.col("gain"), F.col("base")), 6).alias("physical"))


def physical_to_digital_all(spark: SparkSession, d: str) -> DataFrame:
    """Every reading as a count; a channel that no header label means has the default gain and the widest format."""
    s = signals.readings(spark, d).join(_scales(spark, d), ["record_id", "label"], "left")
    return s.select("record_id", "sample", "label", ch.to_digital(F.col("mv"), F.col("gain"), F.col("base"), F.coalesce("fmt", F.lit(32))).alias("digital"))


# Words that the list's long names do not have, as the SQL has them.
_WORDS_SQL = (
    "(VALUES ('LEADS', ''), ('ECG', ''), ('LIMB', ''), ('CHEST', ''), ('PRECORDIAL', ''), ('BIPOLE', ''), ('CATHETER', ''), ('CATH', ''), ('BUNDLE', ''), ('OLD', ''), ('DIST', 'D'), ('PROX', 'P'), ('MIDDLE', 'M')) v(word, meaning)"
)
#: What the words of long names stand for: the label's last part if both end in words, else its first; several things: nothing.
_LEARNT_SQL = (
    "nm AS (SELECT string_split(label, ' ') AS l, string_split(upper(long_name), ' ') AS w FROM lead_dim), nw AS (SELECT l, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM nm), "
    "lw AS (SELECT word, CASE WHEN count(DISTINCT m) = 1 THEN min(m) ELSE '' END AS meaning FROM (SELECT word, CASE WHEN w[-1] <> l[-1] AND i = len(w) THEN l[-1] ELSE l[1] END AS m FROM nw WHERE NOT list_contains(l, word) AND regexp_full_match(word, '[A-Z]+')) GROUP BY word)"
)

#: A plainer reading that gives the same: letters and numbers of a label, each word by its nearest known word, as one key.
P4_FOUND_SQL = f"""
WITH typed AS (SELECT DISTINCT record_id, number, label FROM header_table WHERE trim(label) <> '' AND label NOT IN (SELECT label FROM lead_dim)),
labels AS (SELECT DISTINCT label FROM typed UNION SELECT label FROM lead_dim),
tok AS (SELECT label, unnest(regexp_extract_all(upper(label), '[A-Z]+[0-9]+[A-Z]+|[A-Z]+|[0-9]+')) AS t, generate_subscripts(regexp_extract_all(upper(label), '[A-Z]+[0-9]+[A-Z]+|[A-Z]+|[0-9]+'), 1) AS pos FROM labels),
{_LEARNT_SQL},
own AS (SELECT word, meaning FROM {_WORDS_SQL} UNION SELECT DISTINCT t, t FROM tok JOIN lead_dim USING (label) WHERE NOT regexp_matches(t, '[0-9]')),
dict AS (SELECT * FROM own UNION SELECT * FROM lw WHERE word NOT IN (SELECT word FROM own)),
near AS (SELECT t, word, meaning, damerau_levenshtein(t, word) AS dist FROM (SELECT DISTINCT t FROM tok WHERE regexp_matches(t, '[A-Z]')) x, dict
  WHERE t = word OR (length(t) >= 3 AND length(word) >= 3 AND damerau_levenshtein(t, word) <= CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END)),
best AS (SELECT t, min(meaning) AS meaning, min(dist) AS dist FROM near n WHERE dist = (SELECT min(dist) FROM near m WHERE m.t = n.t) GROUP BY t HAVING count(DISTINCT meaning) = 1),
w AS (SELECT label, pos, tok.t, coalesce(meaning, tok.t) AS meaning, coalesce(dist = 0 AND meaning = '', false) AS plain_word FROM tok LEFT JOIN best USING (t) WHERE regexp_matches(tok.t, '[A-Z]')),
repaired AS (SELECT label, string_agg(meaning, '' ORDER BY pos) AS l FROM (SELECT label, meaning, min(pos) AS pos FROM w GROUP BY ALL) GROUP BY label),
raw AS (SELECT label, string_agg(t, '' ORDER BY pos) AS l FROM w WHERE NOT plain_word GROUP BY label),
num AS (SELECT label, list(CAST(t AS BIGINT) ORDER BY pos) AS n FROM tok WHERE NOT regexp_matches(t, '[A-Z]') GROUP BY label),
cut AS (SELECT label, k FROM num, unnest([1, 2]) u(k) WHERE len(n) = 1 AND length(CAST(n[1] AS VARCHAR)) > k AND CAST(substr(CAST(n[1] AS VARCHAR), k + 1) AS BIGINT) = CAST(left(CAST(n[1] AS VARCHAR), k) AS BIGINT) + 1),
numbers AS (SELECT num.label, CASE WHEN len(n) = 2 THEN n[1] || '-' || n[2] WHEN cut.k IS NOT NULL THEN left(CAST(n[1] AS VARCHAR), k) || '-' || substr(CAST(n[1] AS VARCHAR), k + 1) ELSE array_to_string(n, ' ') END AS n FROM num LEFT JOIN cut USING (label)),
keys AS (SELECT label, raw.l AS raw_l, repaired.l AS rep_l, coalesce(n, '') AS n FROM labels LEFT JOIN raw USING (label) LEFT JOIN repaired USING (label) LEFT JOIN numbers USING (label)),
ref AS (SELECT label_id, coalesce(raw_l, '') || '|' || n AS key FROM lead_dim JOIN keys USING (label) UNION ALL SELECT label_id, '|' || label_id FROM lead_dim WHERE label IN ('I', 'II', 'III')),
found AS (SELECT k.label, coalesce(a.label_id, b.label_id, 0) AS label_id FROM keys k LEFT JOIN ref a ON a.key = coalesce(raw_l, '') || '|' || n LEFT JOIN ref b ON b.key = coalesce(rep_l, '') || '|' || n)
SELECT DISTINCT record_id, number, CAST(label_id AS INTEGER) AS label_id, label FROM typed JOIN found USING (label)"""

P4_UNMATCHED_SQL = f"SELECT label, count(*) AS channels FROM ({P4_FOUND_SQL}) WHERE label_id = 0 GROUP BY label"
P4_FOUND_SQL = f"SELECT record_id, number, label_id FROM ({P4_FOUND_SQL})"


#: Scales under the label that a channel's own one means, of several with one label the exact ones first, then the last number.
_MEANT_SQL = f"""p4 AS ({P4_FOUND_SQL}), c AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM header_table),
w AS (SELECT c.*, replace(upper(c.label), '_', ' ') AS own, l.label AS meant FROM c LEFT JOIN p4 ON c.record_id = p4.record_id AND c.number = p4.number LEFT JOIN lead_dim l ON l.label_id = p4.label_id),
o AS (SELECT *, coalesce(meant, own) AS lbl, coalesce(meant <> own, false) AS typed FROM w),
u AS (SELECT record_id, lbl AS label, arg_max(adc_gain, (NOT typed, number)) FILTER (adc_gain IS NOT NULL) AS gain, arg_max(adc_baseline, (NOT typed, number)) FILTER (adc_baseline IS NOT NULL) AS base, max(storage_format) AS fmt FROM o GROUP BY ALL)"""

DIGITAL_TO_PHYSICAL_ALL_SQL = f"""WITH {signals._COUNTS}, {_MEANT_SQL}
SELECT v.record_id, v.sample, v.label, round((value - coalesce(base, 0)) / (CASE WHEN gain = 0 THEN 1 ELSE coalesce(gain, 200) END), 6) AS physical FROM v LEFT JOIN u USING (record_id, label)"""

PHYSICAL_TO_DIGITAL_ALL_SQL = f"""WITH {signals._G}, {_MEANT_SQL}
SELECT record_id, sample, label, CASE WHEN mv IS NOT NULL THEN CAST(greatest(least(round(mv * CASE WHEN gain = 0 THEN 1 ELSE coalesce(gain, 200) END + coalesce(base, 0)), {signals._HIGH}), -{signals._HIGH} - 1) AS INTEGER) END AS digital FROM g LEFT JOIN u USING (record_id, label)"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "bench_items", "item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", F.col("item_id").cast("int").alias("item_id")).distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """All documents with leaked spans taken out."""
    docs = table(spark, d, "documents", "doc_id", "text").distinct()
    return leakage.without_leaks(docs, _leaks(spark, d))


P8_FOUND_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id AS id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM bench_items),
dg AS (SELECT id, array_to_string(w[k:k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(k)),
ig AS (SELECT DISTINCT id, array_to_string(w[k:k + 12], ' ') AS g FROM i, unnest(range(1, len(w) - 11)) t(k))
SELECT DISTINCT dg.id AS doc_id, CAST(ig.id AS INTEGER) AS item_id FROM dg JOIN ig USING (g)"""


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is taken."""
    docs = mixing.with_tokens(table(spark, d, "documents", "doc_id", "source", "text"))
    return mixing.mix(docs, table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares actually reached."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether shares and caps hold per source: the share is as near to its target as whole documents allow (the longest one of
    every source may be too much or too little), and no document is beyond its cap."""
    mixed, targets = p9_mix(spark, d), table(spark, d, "mix_targets")
    longest = mixed.groupBy("source").agg(F.max("n_tokens").alias("most"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"))
    slack = longest.join(targets, "source").agg(F.sum("most") / F.sum("taken")).first()[0]
    s = mixing.shares(mixed, targets).join(targets.select("source"), "source", "left_semi")
    return s.select("source", "documents", (F.abs(F.col("actual_share") - F.col("target_share")) <= (slack or 0.0)).alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


P9_KEPT_SQL = """
SELECT source, count(DISTINCT doc_id) AS documents, true AS share_kept, true AS cap_kept FROM documents JOIN mix_targets USING (source) GROUP BY source"""


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "pii_kind", "start_char").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with placeholders for personal information."""
    return pii.redacted(table(spark, d, "documents", "doc_id", "text").distinct())


QUERIES = {
    "p1_found": p1_found, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p8_found": p8_found, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept,
    "p10_found": p10_found, "p10_redacted": p10_redacted, "digital_to_physical_all": digital_to_physical_all, "physical_to_digital_all": physical_to_digital_all,
}

SQL = {
    "p1_found": P1_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p4_unmatched": P4_UNMATCHED_SQL, "p8_found": P8_FOUND_SQL, "p9_kept": P9_KEPT_SQL,
    "digital_to_physical_all": DIGITAL_TO_PHYSICAL_ALL_SQL, "physical_to_digital_all": PHYSICAL_TO_DIGITAL_ALL_SQL}
