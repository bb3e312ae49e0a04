"""Two-level windows give what plain windows give, whatever the chunk; one key holds a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leadframe.operators import intervals
from leadframe.operators.chunked import first_later, over_blocks, ranked, running


def _rows(n=400, seed=5):
    r = random.Random(seed)
    keys = ["hot"] * 3 + [None] + [f"k{i}" for i in range(5)]
    return [(r.choice(keys), r.randrange(200), r.choice([None, r.randrange(50)]), i) for i in range(n)]


@pytest.mark.parametrize("width", [3, 1000])
def test_running_and_first_later(spark, width):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, p int, v int, i int").withColumn("c", F.floor(F.col("p") / width))
    order = [F.col("p"), F.col("i")]
    out = running(df, ["k"], "c", order, F.col("v"), "max", "top")
    out = running(out, ["k"], "c", order, F.col("v"), "sum", "total", inclusive=True)
    out = first_later(out, ["k"], "c", "p", F.when(F.col("v") > 25, F.col("p")), "next")
    got = {r["i"]: (r["top"], r["total"], r["next"]) for r in out.collect()}
    assert set(got) == {x[3] for x in rows if x[0]}
    for k, p, v, i in (x for x in rows if x[0]):
        before = [x for x in rows if x[0] == k and (x[1], x[3]) < (p, i) and x[2] is not None]
        upto = sum(x[2] for x in before) + (v or 0)
        later = [x[1] for x in rows if x[0] == k and x[1] > p and (x[2] or 0) > 25]
        assert got[i] == (max((x[2] for x in before), default=None), upto, min(later, default=None))


@pytest.mark.parametrize("block", [4, 7, 10_000])
def test_blocks_do_not_matter(spark, block):
    rows = sorted({(k, p, v) for k, p, v, _ in _rows(seed=8) if k and v is not None})
    df = spark.createDataFrame(rows, "k string, p int, v int")
    out = over_blocks(df, ["k"], "p", 4, lambda w: {"a": F.lag("v", 3).over(w), "s": F.sum("v").over(w.rowsBetween(-2, 2))}, block)
    got = sorted((r["k"], r["p"], r["v"], r["a"] if r["a"] is not None else -1, r["s"]) for r in out.collect())
    want = []
    for k in {r[0] for r in rows}:
        x = [r for r in rows if r[0] == k]
        want += [(*r, x[i - 3][2] if i >= 3 else -1, sum(q[2] for q in x[max(0, i - 2) : i + 3])) for i, r in enumerate(x)]
    assert got == sorted(want)


def test_margin_must_fit(spark):
    with pytest.raises(ValueError):
        over_blocks(spark.createDataFrame([("a", 1)], "k string, p int"), ["k"], "p", 9, lambda w: {}, 4)


def test_rank_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "k string, p int"), ["k"], "p").count() == 0


def _brute(rows):
    iv = set()
    for r, n, s, t in rows:
        if t == "(" and None not in (r, n, s):
            ends = [x[2] for x in rows if x[0] == r and x[1] == n and x[3] == ")" and x[2] is not None and x[2] > s]
            if ends:
                iv.add((r, s, min(ends)))
    gaps, periods = set(), set()
    for r in {x[0] for x in iv}:
        cur = None
        for _, a, b in sorted(x for x in iv if x[0] == r):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    gaps.add((r, cur[1], a))
                    periods.add((r, *cur))
                cur = [a, b]
        periods.add((r, *cur))
    return gaps, periods


@pytest.mark.parametrize("width", [5, 64, 1 << 16])
def test_intervals(spark, width):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "b", "c", None]), r.choice([0, 1, 2, None]), r.choice([None, *range(120)]), r.choice("()N")) for _ in range(250)]
    rows += rows[:20]
    marks = spark.createDataFrame([(*x, "spare") for x in rows], "record_id string, number int, sample int, type string, start string")
    iv = intervals.pair_bounds(marks, ["record_id", "number"], "sample", "type", chunk_width=width)
    gaps = {tuple(x) for x in intervals.gaps(iv, ["record_id"], width).collect()}
    periods = {tuple(x)[:3] for x in intervals.periods(iv, ["record_id"], width).collect()}
    assert (gaps, periods) == _brute(rows)


def test_touching_nested_and_empty(spark):
    iv = spark.createDataFrame([("a", 0, 10), ("a", 10, 12), ("a", 2, 3), ("a", 20, 30), ("b", 1, 2), ("c", 5, 4), ("c", None, 4)], "record_id string, start int, stop int")
    assert [tuple(x) for x in intervals.gaps(iv, ["record_id"]).collect()] == [("a", 12, 20)]
    assert intervals.gaps(iv.limit(0), ["record_id"]).count() == 0
