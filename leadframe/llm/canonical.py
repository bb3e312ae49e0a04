"""Mapping hand-typed values to the entry of a reference list that they mean.

Values are cut into tokens. Each distinct token is joined to the vocabulary of the reference by edit distance: token and
word meet where they share a form with one letter left out, so that no pair is formed that is not close. The repaired
tokens then rank whole entries by soft TF-IDF: a token counts by its rarity in the reference and by how closely it was
read; a token the reference does not know counts fully against the match. Below a threshold a value means no entry.

What words stand for is learnt from the reference itself where it has longer names beside the short ones (coronary sinus
beside CS). Value and entry meet only in a token that is among the rarest of both: without one they cannot reach the
threshold, so that a token that many entries share pairs nothing by itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe.operators.durable import durable

# Words beside channel names that the list's long names do not have; "" for words that name no channel by themselves.
CHANNEL_WORDS = {
    "LEADS": "", "ECG": "", "LIMB": "", "CHEST": "", "PRECORDIAL": "", "BIPOLE": "", "CATHETER": "", "CATH": "", "BUNDLE": "", "OLD": "", "DIST": "D", "PROX": "P", "MIDDLE": "M",
}
# Other names of entries.
CHANNEL_NAMES = {"1": "I", "2": "II", "3": "III"}

_RUNS = re.compile(r"[^\W\d_]+[0-9]+[^\W\d_]+|[^\W\d_]+|[0-9]+")


def tokens(text: str | None) -> list[str]:
    """Words, numbers and number pairs of a text, upper case.

    Numbers lose leading zeros. Two numbers that follow one another, n and n+1, are one pair n-(n+1), also where they are
    written without anything between (78, 1112). A digit inside letters (H1S) stays in its word.
    """
    t = unicodedata.normalize("NFKC", text or "").upper()
    found = [x.lstrip("0") or "0" if x.isdigit() else x for x in _RUNS.findall(t)]
    out: list[str] = []
    i = 0
    while i < len(found):
        x = found[i]
        if x.isdigit() and i + 1 < len(found) and found[i + 1].isdigit():
            out.append(f"{x}-{found[i + 1]}")
            i += 2
            continue
        if x.isdigit() and 2 <= len(x) <= 12:
            cut = next((k for k in range(1, len(x)) if int(x[k:]) == int(x[:k]) + 1 and x[k] != "0"), 0)
            x = f"{x[:cut]}-{x[cut:]}" if cut else x
        out.append(x)
        i += 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(s: pd.Series) -> pd.Series:
    return s.map(tokens)


def _left_out(token: Column) -> Column:
    """The token and its forms with one letter left out."""
    n = F.length(token)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))
    return F.array_distinct(F.concat(F.array(token), shorter))


def _forms(token: Column, long: int, longest: int) -> Column:
    """Forms by which close tokens meet: one letter left out, of ``long`` to ``longest`` letters two."""
    once = _left_out(token)
    return F.when(F.length(token).between(long, longest), F.array_distinct(F.flatten(F.transform(once, _left_out)))).otherwise(once)


def _swaps(token: Column) -> Column:
    """The token and its forms with two neighbouring letters swapped."""
    n = F.length(token)
    swapped = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.lit(1)), F.substring(token, i, F.lit(1)), F.substring(token, i + 2, n)),
    )
    return F.concat(F.array(token), F.when(n > 1, swapped).otherwise(F.array().cast("array<string>")))


def repair(found: DataFrame, vocabulary: DataFrame, shortest: int = 3, long: int = 8, twice: int = 24, longest: int = 64) -> DataFrame:
    """(``token``, ``word``, ``meaning``, ``closeness``) for distinct tokens that the vocabulary has or nearly has.

    ``vocabulary`` has ``word`` and ``meaning``. A token is its own word if there is one; else, with ``shortest`` letters
    or more, a word one edit away (a letter changed, left out, put in, or two neighbours swapped), and for words
    of ``long`` to ``twice`` letters one two edits away. The fewest edits decide; if such words differ in meaning the
    token stays unread. Words of more than ``longest`` letters are matched exactly only.
    """
    exact = found.join(vocabulary, found["token"] == vocabulary["word"]).select("token", "word", "meaning", F.lit(1.0).alias("closeness"))
    unknown = found.join(vocabulary, found["token"] == vocabulary["word"], "left_anti").filter(F.length("token").between(shortest, longest + 1) & F.col("token").rlike(r"\p{L}"))
    near = unknown.select("token", F.explode(_forms(F.col("token"), long - 2, twice + 2)).alias("form"))
    words = vocabulary.filter(F.length("word").between(shortest, longest)).select("word", "meaning", F.explode(_forms(F.col("word"), long, twice)).alias("form"))
    pairs = near.join(words, "form").select("token", "word", "meaning").distinct()
    away = F.levenshtein("token", "word")
    swapped = F.transform(_swaps(F.col("token")), lambda x: F.levenshtein(x, F.col("word")))
    edits = F.when(away <= 1, away).when(F.exists(swapped, lambda x: x == 0), 1).when(
        F.length("word").between(long, twice) & ((away == 2) | F.exists(swapped, lambda x: x == 1)), 2
    )
    close = pairs.withColumn("edits", edits).filter("edits is not null")
    least = close.groupBy("token").agg(F.min("edits").alias("edits"))
    one = close.join(least, ["token", "edits"]).groupBy("token").agg(
        F.min("word").alias("word"), F.min("meaning").alias("meaning"), F.count_distinct("meaning").alias("_n"), F.min("edits").alias("edits")
    )
    closeness = 1 - 0.5 * F.col("edits") / F.greatest(F.length("token"), F.length("word"))
    return exact.unionByName(one.filter("_n = 1").select("token", "word", "meaning", closeness.alias("closeness")))


def words_of_names(reference: DataFrame, short: str, long: str) -> DataFrame:
    """(``word``, ``meaning``): what words of the long names stand for in the short ones.

    Tokens that both names have stand for themselves. If the last tokens differ, the last word stands for the last token; all
    other words stand for the first one. A word that stands for several things by different entries stands for nothing ("").
    """
    r = reference.select(_tokens(short).alias("s"), _tokens(long).alias("l")).dropna().filter((F.size("s") > 0) & (F.size("l") > 0))
    both = F.arrays_overlap(F.slice("s", -1, 1), F.slice("l", -1, 1))
    pairs = F.transform(
        "l", lambda w, i: F.struct(w.alias("word"), F.when(~both & (i == F.size("l") - 1), F.element_at("s", -1)).otherwise(F.element_at("s", 1)).alias("meaning"))
    )
    own = F.filter(pairs, lambda p: ~F.array_contains("s", p["word"]) & p["word"].rlike(r"^\p{L}+$"))
    each = r.select(F.explode(own).alias("p")).select("p.word", "p.meaning")
    return each.groupBy("word").agg(F.when(F.count_distinct("meaning") == 1, F.min("meaning")).otherwise("").alias("meaning"))


def _prefix(tokens: Column, norm: Column, threshold: float) -> Column:
    """Meanings of ``tokens`` (structs with ``idf``, ``meaning``; rarest first) from which on the rest may still reach the threshold."""
    n = F.size(tokens)
    rest = lambda i: F.aggregate(F.slice(tokens, i + 1, n), F.lit(0.0), lambda acc, x: acc + x["idf"] * x["idf"])
    kept = F.filter(F.transform(tokens, lambda x, i: F.struct(x["meaning"].alias("meaning"), rest(i).alias("rest"))), lambda x: x["rest"] >= threshold * threshold * norm * norm - 1e-9)
    return F.transform(kept, lambda x: x["meaning"])


def _weighed(bag: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, ``tokens``, ``norm``, ``prefix``) of a bag with ``meaning``, ``idf`` and perhaps ``closeness``."""
    more = ["closeness"] if "closeness" in bag.columns else []
    b = bag.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idf", "meaning", *more)), asc=False).alias("tokens"))
    b = b.withColumn("norm", F.sqrt(F.aggregate("tokens", F.lit(0.0), lambda acc, x: acc + x["idf"] * x["idf"])))
    return b.withColumn("prefix", _prefix(F.col("tokens"), F.col("norm"), threshold))


def map_to_reference(
    values: DataFrame,
    value: str,
    reference: DataFrame,
    ref_id: str,
    ref_text: str,
    words: Mapping[str, str] | None = None,
    names: Mapping[str, str] | None = None,
    threshold: float = 0.9,
    long_text: str | None = None,
) -> DataFrame:
    """One row per distinct non-null ``value``: (``value``, ``ref_id``, ``score``); null id where it means no entry.

    ``words`` says what words stand for ("": nothing by themselves), ``names`` gives further whole names of entries by
    their text, and ``long_text`` a column of longer names, whose words are learnt (``words`` goes before). The reference may
    be of any size. Among entries of equal score the smaller id is taken. Blank values and values of unweighted words alone
    mean no entry; so does everything if the reference is empty. ``score`` is that of the best entry that might reach the
    threshold, else 0. Distinct values, their tokens and the vocabulary are kept in the checkpoint folder, as each is read
    several times.
    """
    spark = values.sparkSession
    words, names = dict(words or {}), dict(names or {})
    # Entries, each under its own text and under its further names.
    entries = reference.select(F.col(ref_id).alias("id"), F.col(ref_text).alias("text")).dropna().distinct()
    more = spark.createDataFrame([(k, v) for k, v in names.items()] or [("", "")], "name string, text string").filter("name <> ''")
    listed = entries.select("id", "text", F.col("text").alias("name")).unionByName(entries.join(more, "text").select("id", "text", "name"))
    listed = durable(listed.select("id", "name", _tokens("name").alias("tokens")))
    bag_of = listed.select("id", "name", F.explode(F.array_distinct("tokens")).alias("meaning"))
    n = listed.select("id").distinct().count()
    rarity = durable(bag_of.groupBy("meaning").agg(F.count_distinct("id").alias("df")).select("meaning", F.log(1 + n / F.col("df")).alias("idf")))
    index = _weighed(bag_of.join(rarity, "meaning"), ["id", "name"], threshold)
    # Vocabulary: the entries' own tokens, the words given, the words of longer names.
    given = spark.createDataFrame([(k, v) for k, v in words.items()] or [("", "")], "word string, meaning string").filter("word <> ''")
    own = rarity.select(F.col("meaning").alias("word"), "meaning").join(given, "word", "left_anti")
    vocabulary = own.unionByName(given)
    if long_text is not None:
        learnt = words_of_names(reference, ref_text, long_text)
        vocabulary = vocabulary.unionByName(learnt.join(vocabulary, "word", "left_anti"))
    vocabulary = durable(vocabulary)
    joined = listed.select(F.filter("tokens", lambda t: t.rlike(r"^\p{L}+$")).alias("parts"))
    joined = joined.filter(F.size("parts") > 0).select(F.array_join("parts", "").alias("written"), "parts").dropDuplicates(["written"])

    typed = durable(values.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()).distinct().withColumn("tokens", _tokens("value")))
    at = typed.select("value", F.posexplode("tokens").alias("pos", "token"))
    read = repair(durable(at.select("token").distinct()), vocabulary)
    seen = durable(at.join(read, "token", "left").withColumn("unweighted", F.coalesce(F.col("meaning") == "", F.lit(False))))
    plain = seen.filter(~F.col("unweighted")).select("value", F.lit(0).alias("way"), F.coalesce("meaning", "token").alias("meaning"), F.coalesce("closeness", F.lit(1.0)).alias("closeness"))
    # A second way to read a value: its letters together are an entry's, however they were parted.
    letters = seen.filter(~F.col("unweighted") & F.col("token").rlike(r"^\p{L}+$")).groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("written"))
    together = letters.join(joined, "written").select("value", F.explode("parts").alias("meaning"))
    numbers = plain.join(together.select("value").distinct(), "value", "left_semi").filter(~F.col("meaning").rlike(r"^\p{L}+$")).select("value", "meaning", "closeness")
    second = together.withColumn("closeness", F.lit(1.0)).unionByName(numbers).withColumn("way", F.lit(1))
    bag = plain.unionByName(second).groupBy("value", "way", "meaning").agg(F.max("closeness").alias("closeness"))
    strange = F.lit(math.log(n + 1.0))  # a token of no entry is as rare as can be
    bag = bag.join(rarity, "meaning", "left").withColumn("idf", F.coalesce("idf", strange))
    asked = _weighed(bag, ["value", "way"], threshold).select("value", "tokens", "norm", F.explode("prefix").alias("meaning"))
    offered = index.select("id", F.transform("tokens", lambda x: x["meaning"]).alias("has"), F.col("norm").alias("entry_norm"), F.explode("prefix").alias("meaning"))
    shared = F.aggregate(F.filter("tokens", lambda x: F.array_contains("has", x["meaning"])), F.lit(0.0), lambda acc, x: acc + x["closeness"] * x["idf"] * x["idf"])
    scored = asked.join(offered, "meaning").select("value", "id", (shared / (F.col("entry_norm") * F.col("norm"))).alias("score"))
    best = scored.groupBy("value", "id").agg(F.round(F.max("score"), 9).alias("score"))
    top = best.groupBy("value").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("id"))).alias("t")) if dict(reference.dtypes)[ref_id] in _WHOLE else None
    if top is None:
        w = Window.partitionBy("value").orderBy(F.desc("score"), "id")
        top = best.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("value", F.struct("id", "score").alias("t"))
    out = typed.select("value").join(top.select("value", "t.id", "t.score"), "value", "left")
    return out.select("value", F.when(F.col("score") >= threshold, F.col("id")).alias(ref_id), F.coalesce("score", F.lit(0.0)).alias("score"))


_WHOLE = ("tinyint", "smallint", "int", "bigint")
