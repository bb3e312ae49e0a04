"""Mixing sources to target shares of all tokens.

Each document gets a rate: how often it is taken. Rates are the closest to one each, in relative entropy, among those
that give every source its tokens and repeat none beyond its cap; they are exponentially tilted in the tokens of the
document, one tilt per source, which Newton steps on the convex dual find. A step is one aggregate over the counts of
documents by (source, tokens), to which every document contributes. Rates are then rounded to whole copies by a hash of
the document, with a threshold per source that makes the tokens come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.operators.durable import durable

#: A tokenizer file in the JSON form of the tokenizers library, at one place on all executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def with_tokens(documents: DataFrame, text: str = "text", name: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` without ``text`` but with ``name``, the tokens of the whole text; null and empty texts have 0."""
    kept = [c for c in documents.columns if c != text]
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{name}` bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x or "" for x in b[text].to_pylist()]
            counts = [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(counts, pa.int64())], names=[*kept, name])

    return documents.mapInArrow(work, schema)


def _table(rows: dict, key: Column, default: float) -> Column:
    """A per-source number as an expression; sources are few."""
    entries = [F.lit(x) for k, v in rows.items() for x in (k, float(v))]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default)) if entries else F.lit(default)


def solve_tilts(histogram: DataFrame, goals: dict[str, float], caps: dict[str, int], scale: dict[str, float], rounds: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """The tilt of each source: rate(t) = min(cap, exp(tilt * t / scale)) with tokens summing to the goal.

    ``histogram`` has ``source``, ``n_tokens``, ``n``. Newton steps are kept inside a bracket that every step narrows.
    A goal that the cap only just allows is met by an infinite tilt.
    """
    tilt = dict.fromkeys(goals, 0.0)
    low, high = dict.fromkeys(goals, -math.inf), dict.fromkeys(goals, math.inf)
    done: dict[str, float] = {}
    for _ in range(rounds):
        open_ = {k: v for k, v in tilt.items() if k not in done}
        if not open_:
            break
        x = F.col("n_tokens") / _table(scale, F.col("source"), 1.0)
        power = F.least(_table(open_, F.col("source"), 0.0) * x, F.lit(700.0))
        cap = _table(caps, F.col("source"), 1.0)
        rate = F.least(F.exp(power), cap)
        at = (
            histogram.filter(F.col("source").isin(*open_))
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("n_tokens") * rate).alias("f"), F.sum(F.when(F.exp(power) < cap, F.col("n") * F.col("n_tokens") * rate * x).otherwise(0.0)).alias("df"))
            .collect()
        )
        for r in at:
            k, gap = r["source"], r["f"] - goals[r["source"]]
            if abs(gap) <= tolerance * max(goals[k], 1.0):
                done[k] = tilt[k]
                continue
            (high if gap > 0 else low)[k] = tilt[k]
            step = tilt[k] - gap / r["df"] if r["df"] > 0 else math.inf
            if not low[k] < step < high[k]:
                lo, hi = low[k], high[k]
                step = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (2 * lo + 1 if math.isfinite(lo) else 2 * hi - 1)
            tilt[k] = step
    return tilt | done


def _unit(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return (F.xxhash64(key, F.lit("copies")).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", tokens: str = "n_tokens", total: float | None = None, fill: float = 0.95) -> DataFrame:
    """(``doc_id``, ``source``, ``n_tokens``, ``rate``, ``copies``), one row per document.

    ``targets`` has source, target_share, max_repeats (few rows: it is read by the driver). ``total`` tokens are aimed
    at; by default ``fill`` of the most that caps and shares allow. No copies exceed the cap. Documents of a source
    without a target, or of null source, get 0 copies; documents without tokens get at least one if their source has a target.
    Sources without tokens are left out and the other shares are scaled up. Rows delivered again count once. An empty
    table gives an empty table.
    """
    docs = durable(
        documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).alias("n_tokens")).dropDuplicates(["doc_id"])
    )
    histogram = durable(docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: (float(r["t"]), r["n"]) for r in histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect() if r["source"] is not None}
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()}
    usable = {k: v for k, v in wanted.items() if v[0] > 0 and v[1] > 0 and have.get(k, (0, 0))[0] > 0}
    shares = {k: v[0] / sum(x[0] for x in usable.values()) for k, v in usable.items()}
    caps = {k: v[1] for k, v in usable.items()}
    if not usable:
        return docs.withColumn("rate", F.lit(0.0)).withColumn("copies", F.lit(0))
    most = min(caps[k] * have[k][0] / shares[k] for k in usable)
    total = min(total, most) if total is not None else fill * most
    goals = {k: shares[k] * total for k in usable}
    scale = {k: have[k][0] / have[k][1] for k in usable}
    tilts = solve_tilts(histogram, goals, caps, scale)
    known = F.col("source").isin(*usable)
    power = F.least(_table(tilts, F.col("source"), 0.0) * F.col("n_tokens") / _table(scale, F.col("source"), 1.0), F.lit(700.0))
    cap = _table(caps, F.col("source"), 0.0)
    rated = docs.withColumn("rate", F.when(known, F.least(F.exp(power), cap)).otherwise(0.0))
    # A document gets its next whole copy if the part of its rate beyond the last exceeds its hash by more than the threshold.
    rated = rated.withColumn("_base", F.floor("rate")).withColumn("_key", F.col("rate") - F.col("_base") - _unit(F.col("doc_id")))
    cut = _thresholds(rated.filter(known), goals, caps)
    extra = (F.col("_base") < cap) & (F.col("_key") > _table(cut, F.col("source"), 0.0))
    copies = F.when(known, F.col("_base") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("int")
    return rated.withColumn("copies", copies).drop("_base", "_key")


def _thresholds(rated: DataFrame, goals: dict[str, float], caps: dict[str, int], bins: int = 1024, rounds: int = 3) -> dict[str, float]:
    """Per source the threshold on ``_key`` above which one more copy brings the tokens nearest to the goal.

    Each round counts tokens in ``bins`` bins of the range left, and keeps the bin in which the goal falls.
    """
    low, high = dict.fromkeys(goals, -1.0), dict.fromkeys(goals, 1.0)
    base = {r["source"]: float(r["t"]) for r in rated.groupBy("source").agg(F.sum(F.col("_base") * F.col("n_tokens")).alias("t")).collect()}
    above = dict.fromkeys(goals, 0.0)  # tokens of keys above the range
    room = rated.filter(F.col("_base") < _table(caps, F.col("source"), 0.0))
    for last in [False] * (rounds - 1) + [True]:
        lo, hi = _table(low, F.col("source"), 0.0), _table(high, F.col("source"), 0.0)
        inside = room.filter((F.col("_key") > lo) & (F.col("_key") <= hi))
        b = F.least(F.floor((F.col("_key") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        counted: dict[str, dict[int, float]] = {}
        for r in inside.groupBy("source", b.alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
            counted.setdefault(r["source"], {})[r["b"]] = float(r["t"])
        for k in goals:
            width, need, got = (high[k] - low[k]) / bins, goals[k] - base.get(k, 0.0), above[k]
            for i in range(bins - 1, -1, -1):
                t = counted.get(k, {}).get(i, 0.0)
                if got + t >= need or i == 0:
                    if last and got + t - need < need - got:  # with the documents at the goal itself it is nearer
                        got += t
                        i -= 1
                    low[k], high[k], above[k] = low[k] + i * width, low[k] + (i + 1) * width, got
                    break
                got += t
    return high


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and cap, documents, tokens, copies, the most copies of one document, tokens taken, actual share."""
    by = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_taken"),
    )
    taken = by.agg(F.sum("tokens_taken").alias("t")).first()["t"]
    out = targets.select("source", "target_share", "max_repeats").distinct().join(by, "source", "full")
    return out.withColumn("actual_share", F.coalesce(F.col("tokens_taken"), F.lit(0)) / F.lit(float(taken or 1)))
