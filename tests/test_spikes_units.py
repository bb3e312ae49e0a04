from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.operators import spikes, units


def _signal(n, seed):
    r = np.random.default_rng(seed)
    x = 0.4 * np.sin(np.arange(n) / 9) + r.normal(0, 0.02, n)
    x[n // 3] += 4
    x[n // 2 : n // 2 + 3] -= np.array([5, 5.2, 5.1])
    x[n // 4 : n // 4 + 22] = x[n // 4]
    x[n // 5 : n // 5 + 19] = 0.123
    x[-5], x[-30], x[-60] = 80.0, math.inf, math.nan
    x[0] = 9.0  # no reading before it: no spike
    return x


def _brute(x):
    n = len(x)
    bad = [not abs(v) <= 50 for v in x]
    stuck = [False] * n
    i = 0
    while i < n:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if j - i + 1 >= 20:
            stuck[i : j + 1] = [True] * (j - i + 1)
        i = j + 1
    spike = [False] * n
    for _ in range(20):
        sound = [v for v, b, s, c in zip(x, bad, stuck, spike) if not (b or s or c)]
        t = 1.5 * (np.percentile(sound, 90) - np.percentile(sound, 10) if not any(spike) else max(sound) - min(sound))
        new = [False] * n
        for length in (1, 2, 3):
            for a in range(1, n - length):
                run = x[a : a + length]
                if all(abs(v - x[a - 1]) > t and abs(v - x[a + length]) > t for v in run):
                    new[a : a + length] = [True] * length
        if new == spike:
            break
        spike = new
    return {i for i in range(n) if bad[i] or stuck[i] or spike[i]}


@pytest.mark.parametrize("block", [25, 64, 1 << 15])
def test_against_brute_force(spark, block):
    rows, want = [], set()
    for s, n in (("hot", 400), ("b", 200)):
        x = _signal(n, n)
        x[0] = 0.0
        gaps = [i + 3 * (i // 7) for i in range(n)]  # missing samples
        rows += [(s, "I", g, float(v), i % 4) for i, (g, v) in enumerate(zip(gaps, x))]
        want |= {(s, gaps[i]) for i in _brute(x)}
    rows += rows[:50] + [("hot", "I", 99_999, None, 0), ("nul", "I", None, 1.0, 0), ("one", "I", 1, 7.0, 0), ("flat", "II", 1, 0.0, 0), ("flat", "II", 2, 0.0, 0)]
    df = spark.createDataFrame(rows, "record_id string, label string, sample int, mv double, rank int").drop("rank")
    out = spikes.implausible(df, ["record_id", "label"], "sample", "mv", block=block)
    assert {(r["record_id"], r["sample"]) for r in out.collect()} == want


def test_end_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "I", i, v, 1.0) for i, v in enumerate([9.0, 0.0, 0.1, 0.0, 0.1, 0.0])], "record_id string, label string, sample int, mv double, isolation double")
    assert spikes.implausible(df, ["record_id", "label"], "sample", "mv").count() == 0
    assert spikes.implausible(df.limit(0), ["record_id", "label"], "sample", "mv").count() == 0


def test_hampel_and_runs():
    x = np.array([1, 1, 1.1, 9, 1, 0.9, 1.0, np.nan, 1])
    assert list(np.flatnonzero(spikes.hampel(x, 3, 3.0, 0.5))) == [3]
    assert list(spikes.run_lengths(np.array([1, 1, 2, 2, 2, np.nan, np.nan]))) == [2, 2, 3, 3, 3, 1, 1]
    assert len(spikes.hampel(np.zeros(0), 3, 3.0, 0.0)) == len(spikes.run_lengths(np.zeros(0))) == 0


CHANNELS = [
    (200.0, "mV", None, None, None, 200.0, "stated"), (0.2, "uV", None, None, None, 200.0, "stated"), (2e5, " volts ", None, None, None, 200.0, "stated"), (2e-4, "nV", None, None, None, 200.0, "stated"),
    (0.005, "mV per bit", None, None, None, 200.0, "stated"), (5.0, "µV/LSB", "noise floor below 3 nV", None, None, 200.0, "stated"), (0.2, "-", "Einheit uV", None, None, 200.0, "stated"), (0.4, None, "unités : microvolts", None, None, 400.0, "stated"),
    (300.0, None, "noise floor below 3 uV", None, None, 300.0, "fitted"), (300.0, "", "calibration pulse 1 V ok", None, None, 300.0, "fitted"), (300.0, "mV", None, 32768, "+/- 5 mV", 6553.6, "range"), (None, "adu", None, 2048, "5000µV", 409.6, "range"),
    (10.0, "mmHg", None, None, None, None, None), (None, "mV", None, None, None, None, None), (0.0, "mV", None, None, None, None, None), (float("nan"), "mV", None, None, None, None, None), (-5.0, "mV", None, None, None, None, None), (float("inf"), "V", None, None, None, None, None),
    (200.0, "mV", None, 0, "5 mV", 200.0, "stated"), (200.0, "mV", None, 32768, "wide", 200.0, "stated"), (200.0, None, "x" * 100_000, None, None, 200.0, "fitted"),
]


def _channels(spark, rows):
    return spark.createDataFrame([(i, *r[:5], "unit?") for i, r in enumerate(rows)], "number int, adc_gain double, adc_units string, info_text string, adc_saturation int, range_text string, label string")


def test_scales(spark):
    out = {r["number"]: r for r in units.counts_per_mv(_channels(spark, CHANNELS)).collect()}
    for i, (*_, want, basis) in enumerate(CHANNELS):
        r = out[i]
        assert r["basis"] == basis and (r["scale_mv"] is None if want is None else abs(r["scale_mv"] - want) < 1e-6), (CHANNELS[i], r)
    assert units.counts_per_mv(_channels(spark, CHANNELS).limit(0)).count() == 0


def test_mixture_finds_missing_units(spark):
    r = random.Random(2)
    gains = [200.0, 400.0, 296.0, 1000.0, 6553.6]
    known = [(r.choice(gains), "mV", None, None, None, None, None) for _ in range(200)]
    hidden = [(u, r.choice(gains)) for u in r.choices(list(units.PER_MV), k=200)]
    rows = known + [(g / units.PER_MV[u], None, None, None, None, None, None) for u, g in hidden]
    out = {x["number"]: x for x in units.counts_per_mv(_channels(spark, rows), default=None).collect()}
    right = [out[200 + i]["unit"] == u for i, (u, _) in enumerate(hidden)]
    assert np.mean(right) >= 0.95
    odd = units.counts_per_mv(_channels(spark, [*known, (30.0, None, None, None, None, None, None)]), default=None).filter(F.col("basis") == "fitted").first()
    assert odd["uncertain"]


@pytest.mark.parametrize("n", [50, 2000])
def test_stated_convention_decides_at_any_size(spark, n):
    known = [(300.0, "mV", None, None, None, None, None)] * 200
    rows = known + [(300.0, None, None, None, None, None, None)] * n + [(0.3, None, None, None, None, None, None)]
    odd = units.counts_per_mv(_channels(spark, rows)).filter("adc_gain = 0.3").first()
    assert odd["unit"] == "mV" and abs(odd["scale_mv"] - 0.3) < 1e-9


def test_a_convention_needs_no_fit(spark, monkeypatch):
    """With a unit for rows that state none nothing is fitted and nothing runs; without one the mixture decides."""
    def fitted(*_, **__):
        raise AssertionError("fitted")

    monkeypatch.setattr(units, "fit_shifted_mixture", fitted)
    rows = [(g, "mV", None, None, None) for g in (200.0, 300.0)] * 20 + [(g, None, None, None, None) for g in (300.0, 0.3, 3e5)] + [(5.0, "mmHg", None, None, None), (None, None, None, 2048, "5 mV"), (-1.0, None, None, None, None)]
    df, sc = _channels(spark, rows), spark.sparkContext
    sc.setJobGroup("convention", "")
    try:
        ours = {u: units.counts_per_mv(df, default=u) for u in ("mV", "uV")}
        assert not sc.statusTracker().getJobIdsForGroup("convention")
    finally:
        sc.setJobGroup("other", "")
    for u, x in ours.items():
        got = x.filter("number >= 40").orderBy("number").collect()
        assert [(r["unit"], r["basis"], r["posterior"], r["uncertain"]) for r in got] == [(u, "fitted", 1.0, False)] * 3 + [(None, None, None, False), (None, "range", 1.0, False), (None, None, None, False)]
        assert [r["scale_mv"] for r in got] == pytest.approx([g * units.PER_MV[u] for g in (300.0, 0.3, 3e5)] + [None, 409.6, None])
    with pytest.raises(AssertionError, match="fitted"):
        units.counts_per_mv(df, default=None)
