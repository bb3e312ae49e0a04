"""Kernels against plain definitions, and the facade end to end."""

from __future__ import annotations

import math
import os
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe import api
from leadframe.functions import dims, dsp
from leadframe.functions.text import elapsed, elapsed_short, make_unique
from leadframe.operators import channels as ch
from leadframe.operators import rhythm, waveforms
from leadframe.plans import signals
from leadframe.streaming.rhythm import stream_windows


def _beats(rate=500, seconds=10, rr=0.8, odd=None, noise=0.01, seed=0):
    n = rate * seconds
    t = np.arange(n) / rate
    at = list(np.arange(0.5, seconds - 0.3, rr))
    if odd is not None:
        at[odd] -= 0.4
    x = sum(1.5 * np.exp(-0.5 * ((t - a) / 0.012) ** 2) for a in at)
    return x + 0.1 * np.sin(2 * np.pi * 6 * t) + np.random.default_rng(seed).normal(0, noise, n), np.array(at)


def test_dimensions():
    assert len(dims.LABELS) == 51 and len(dims.ANNOTATIONS) == 40 and len(set(dims.LABELS)) == 51
    assert dims.LEADS["CS"] == ("CS 9-10", "CS 7-8", "CS 5-6", "CS 3-4", "CS 1-2")


def test_bandpass_gain():
    sections = dsp.butter_bandpass(3, 5.0, 15.0, 250.0)
    at = lambda f: abs(np.prod([np.polyval(s[:3], np.exp(1j * 2 * np.pi * f / 250)) / np.polyval(np.r_[1, s[3:]], np.exp(1j * 2 * np.pi * f / 250)) for s in sections]))
    assert abs(at(5) - math.sqrt(0.5)) < 1e-6 and abs(at(15) - math.sqrt(0.5)) < 1e-6 and at(0) < 1e-12 and abs(at(9) - 1) < 0.01
    with pytest.raises(ValueError):
        dsp.butter_bandpass(3, 0.5, 30.0, 50.0)
    t = np.arange(2000) / 250
    y = dsp.bandpass(np.sin(2 * np.pi * 9 * t) + 3, 250, 5, 15)
    assert np.abs(y - np.sin(2 * np.pi * 9 * t))[300:-300].max() < 0.02  # no phase, no offset


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_sections_in_blocks_are_the_recursion(n):
    x = np.random.default_rng(n).normal(size=n)
    for order, low, high, rate in ((3, 0.5, 30.0, 1000.0), (4, 5.0, 15.0, 250.0)):
        sections, want = dsp.butter_bandpass(order, low, high, rate), x.tolist()
        for b0, b1, b2, a1, a2 in sections.tolist():
            p = q = 0.0
            out = []
            for v in want:
                y = b0 * v + p
                p, q = b1 * v + q - a1 * y, b2 * v - a2 * y
                out.append(y)
            want = out
        assert np.allclose(dsp.sos_filter(sections, x), want, atol=1e-9)


def test_ica_reports_failure_and_tries_every_way(monkeypatch):
    x, _ = _beats(1000, 6)
    y = dsp.bandpass(x, 1000)
    delayed = np.stack([y[k : len(y) - 4 + k] for k in range(5)], axis=1)
    assert dsp.fast_ica(delayed, 1, rounds=1, tolerance=1e-15) is None
    for way in dsp.ICA_WAYS:
        found = dsp.fast_ica(delayed, 1, *way)
        assert found is None or np.allclose(found[0] @ found[1], delayed - delayed.mean(axis=0), atol=1e-6)
    tried = []
    monkeypatch.setattr(dsp, "fast_ica", lambda x, seed, *way: tried.append(way))
    assert np.allclose(dsp.cancel_ica(y, 1000), dsp.cancel_svd(y, 1000)) and tried == list(dsp.ICA_WAYS)


def test_ica_does_not_hang_on_the_number_of_threads():
    code = "import zlib; from leadframe.functions import dsp; from tests.test_features import _beats; print(repr(dsp.rms(dsp.atrial_signal(_beats(100, 150)[0], 100.0, 'ica', zlib.crc32(repr(('r', 'II')).encode()))[0])))"
    made = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": k, "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, check=True).stdout for k in ("1", "4")]
    assert float(made[0]) == pytest.approx(float(made[1]), rel=1e-12) and float(made[0]) > 0


def test_given_atrial_signals_are_measured_as_they_are():
    t = np.arange(4000) / 1000
    x = 0.5 * np.sin(2 * np.pi * 6 * t)
    f = dsp.analyze_atrial_signal(x, 1000.0)
    assert set(f) == {"amplitude", "approximate_entropy", "dominant_rate"} and f["amplitude"] == pytest.approx(0.5 / math.sqrt(2)) and abs(f["dominant_rate"] - 6) < 0.1
    assert f["approximate_entropy"] == pytest.approx(dsp.approximate_entropy(x)) and dsp.analyze_atrial_signal(x, 1000.0, ("dominant_frequency",), f_min=7.0, f_max=8.0)["dominant_rate"] >= 7
    x = np.random.default_rng(3).normal(size=700)
    assert dsp.analyze_atrial_signal(x, 1000.0, ("approximate_entropy",), m=2, r=0.4)["approximate_entropy"] == pytest.approx(dsp.approximate_entropy(x, 2, 0.4, implementation="pairs"), abs=1e-12)
    with pytest.raises(ValueError):
        dsp.approximate_entropy(x, implementation="none")


def test_single_odd_beat_is_bridged_from_the_readings_beside_it():
    x = np.arange(20.0) ** 2
    y = x.copy()
    dsp._bridge(y, 5, 9)
    assert np.allclose(y[5:10], np.linspace(x[4], x[10], 7)[1:-1]) and (y[:5] == x[:5]).all() and (y[10:] == x[10:]).all()


def test_smoothing_keeps_cubics_and_splines_meet_points():
    t = np.arange(60.0)
    assert np.allclose(dsp.savgol(2 + t - 0.1 * t**2 + 0.003 * t**3), 2 + t - 0.1 * t**2 + 0.003 * t**3)
    y = np.sin(t / 5)
    assert np.allclose(dsp.natural_spline(y, t), y) and np.abs(dsp.natural_spline(y, t[:-1] + 0.5) - np.sin((t[:-1] + 0.5) / 5))[5:-5].max() < 1e-3
    assert np.allclose(dsp.natural_spline(np.array([1.0, 3.0]), np.array([0.5])), 2)


def test_upsample():
    x = dsp.upsample(np.sin(np.arange(100) / 10), 10, 100)
    assert len(x) == 1000 and np.abs(np.diff(x)).max() < 0.1
    assert len(dsp.upsample(np.arange(5.0), 1000, 1000)) == 5


def test_qrs_spacing_and_place():
    x, at = _beats()
    found = dsp.detect_qrs(x, 500)
    assert len(found) == len(at) and (np.diff(found) > 101).all() and np.abs(found / 500 - at).max() < 0.15
    assert len(dsp.detect_qrs(np.full(1000, np.nan), 500)) == 0 and len(dsp.detect_qrs(np.zeros(3), 500)) == 0


def test_entropy_against_definition():
    x = np.random.default_rng(1).normal(size=60)
    r = 3.5 * x.std(ddof=1)

    def phi(m):
        v = [x[i : i + m] for i in range(len(x) - m + 1)]
        return np.mean([math.log(sum(np.abs(a - b).max() <= r for b in v) / len(v)) for a in v])

    assert abs(dsp.approximate_entropy(x) - (phi(3) - phi(4))) < 1e-12
    assert dsp.approximate_entropy(x, rows=7) == pytest.approx(dsp.approximate_entropy(x, r=-1))
    assert 0 <= dsp.approximate_entropy(np.random.default_rng(2).normal(size=1000), r=0.2) <= 2
    with pytest.raises(ValueError):
        dsp.approximate_entropy(np.zeros(3))


def test_dominant_frequency():
    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * 6 * t) + np.random.default_rng(0).normal(0, 0.1, 1000)
    assert abs(dsp.dominant_frequency(x, 100) - 6) < 0.2 and dsp.dominant_frequency(x, 100, 60, 70) is None


@pytest.mark.parametrize("cancel", [dsp.cancel_svd, dsp.cancel_ica])
def test_cancellation_takes_beats_out(cancel):
    for odd in (None, 5):
        x, at = _beats(1000, odd=odd)
        y = cancel(dsp.bandpass(x, 1000), 1000)
        assert len(y) == len(x) and np.isfinite(y).all()
        peaks = [int(a * 1000) for i, a in enumerate(at) if i not in (odd,)]
        assert np.abs(y[peaks]).max() < 0.5 * np.abs(x[peaks]).min()
    flat = np.zeros(500)
    assert (cancel(flat, 1000) == flat).all()


def test_features_refuse_unknown_names(spark):
    assert dsp.atrial_features(np.zeros(4), 250.0) == {"amplitude": None}
    x, _ = _beats()
    f = dsp.atrial_features(x, 500.0, ("amplitude", "dominant_frequency"))
    assert 0 < f["amplitude"] < 0.3 and abs(f["dominant_rate"] - 6) < 0.5
    with pytest.raises(ValueError):
        dsp.atrial_features(x, 500.0, ("colour",))


def _recording(spark, rate=500):
    x, at = _beats(rate, 6)
    marks = []
    for i, a in enumerate(at):
        c = int(a * rate)
        for d, t, k in ((-60, "(", 0), (-50, "p", 0), (-40, ")", 0), (-20, "(", 1), (0, "N", 0), (20, ")", 1), (60, "(", 2), (80, "t", 2), (100, ")", 2)):
            if not (i == 3 and t == ")" and k == 2):
                marks.append({"sample": c + d, "type": t, "number": k})
    records, channels = api.header_table(spark, ["I", "II", "CS 1-2"], "r1", float(rate), len(x))
    signal = api.signal_table(spark, {"sample": list(range(len(x))), "I": x.tolist(), "II": (2 * x).tolist(), "CS 1-2": [0.5] * len(x)}, "r1")
    return api.recording(signal, records, channels, api.annotation_table(spark, marks, "ecgpuwave", "r1", float(rate))), len(at)


def test_windows_of_a_recording(spark):
    rec, n = _recording(spark)
    w = api.window(rec, onset_criteria={"type": "(", "number": 0}, offset_criteria={"type": ")", "number": 2}, reference_criteria={"type": "N"})
    rows = w.table.orderBy("onset").collect()
    assert len(rows) == n - 1 and all(r["offset"] - r["onset"] == 160 and r["qrs"] - r["onset"] == 60 for r in rows)
    assert [r["window_id"] for r in rows] == list(range(1, n)) and rows[0]["window_record_name"] == "r1_sinus1"
    s = w.signal()
    assert s.filter("window_id = 1").groupBy("label").count().first()["count"] == 161
    assert w.annotations().filter("window_id = 1 and type = 'N'").first()["sample"] == 61
    std = api.standardize_windows(w, 40)
    assert std.count() == 40 * 3 * (n - 1)
    ends = std.filter("label = 'I'").groupBy("window_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    own = s.filter("label = 'I'").groupBy("window_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    assert all(abs(r["lo"] - r["a"]) < 1e-9 and abs(r["hi"] - r["b"]) < 1e-9 for r in ends.join(own, "window_id").collect())
    aligned = api.standardize_windows(w, 161, align_feature="N", align_mode="center", preserve_amplitude=False).filter("label = 'I' and window_id = 1").orderBy("value", ascending=False).first()
    assert abs(aligned["sample"] - 81) <= 1
    assert api.standardize_windows(w, None, 100.0).filter("window_id = 1 and label = 'I'").count() == 50
    assert w.select([1, 2]).concat(w.select([5])).table.count() == 3
    assert w.map(lambda p: p.groupby(["record_id", "window_id"], as_index=False).agg(n=("value", "size")), "record_id string, window_id long, n long").count() == n - 1
    with pytest.raises(ValueError):
        api.window(rec, "beat")
    with pytest.raises(ValueError):
        api.window(rec, onset_criteria={}, offset_criteria={"type": ")"})
    with pytest.raises(ValueError):
        api.window(rec, onset_criteria={"colour": 1}, offset_criteria={"type": ")"})


def test_facade(spark):
    rec, _ = _recording(spark)
    assert api.is_recording(rec) and not api.is_ecg(rec) and api.is_ecg(api.as_ecg(rec)) and api.is_signal_table(rec.signal) and api.is_header_table(rec.channels) and api.is_annotation_table(rec.annotations)
    assert not api.is_signal_table(3) and not api.is_windowed(rec)
    with pytest.raises(TypeError):
        api.as_ecg(rec.signal)
    assert api.ecg_warnings(rec).first()["warning"] == "expected 12 leads, found 3"
    assert abs(rec.describe().first()["duration_s"] - 6) < 1e-9
    p = api.plot_data(rec, ["CS"], (1.0, 2.0))
    assert p.count() == 501 and p.first()["color"] == "#DFF2F1"
    with pytest.raises(ValueError):
        api.plot_data(rec, ["LEAD 99"])
    with pytest.raises(ValueError):
        api.plot_data(rec, time_frame=(5.0, 9.0))
    assert api.identify_channel_source("RA 1-2") == "HRA"
    with pytest.raises(ValueError):
        api.identify_channel_source("X")
    wide = api.extract_signal(rec)
    assert wide.columns == ["record_id", "sample", "I", "II", "CS 1-2"] and api.extract_signal(rec, "matrix").columns[1] == "I" and api.extract_signal(rec, "array").count() == 3
    f = {r["label"]: r for r in api.extract_f_waves(rec, f_characteristics=["amplitude", "dominant_frequency"]).collect()}
    assert set(f) == {"I", "II"} and abs(f["II"]["amplitude"] / f["I"]["amplitude"] - 2) < 0.05
    m = api.boundary_mask(rec).filter("label = 'I' and wave is not null")
    assert {r["wave"] for r in m.select("wave").distinct().collect()} == {"p", "qrs", "t"}
    assert api.peak_intervals(rec, "I").filter("rr is not null").count() > 3
    assert api.detect_qrs(rec).filter("label = 'I'").count() >= 6
    assert api.wfdb_annotation_labels(spark).count() == 40 and api.wfdb_annotation_labels(spark, ["N", "Q"], [1]).count() == 1


def test_empty_recording(spark):
    s = api.signal_table(spark)
    assert s.count() == 0 and rhythm.local_maxima(s, "value").count() == 0
    rec = api.recording(s, *api.header_table(spark, ["I"], "r"))
    w = api.window(rec, onset_criteria={"type": "("}, offset_criteria={"type": ")"})
    assert w.table.count() == 0 and api.standardize_windows(w).count() == 0 and api.detect_qrs(rec).count() == 0


def test_constructors(spark):
    a = api.annotation_table(spark, [{"sample": 100}, {"sample": None, "type": "N"}], frequency=250.0).orderBy("sample").collect()
    assert [(r["time"], r["type"], r["number"]) for r in a] == [("", "N", 0), ("00:00:00.4", "", 0)]
    _, c = api.header_table(spark, ["ecg", "ECG", "ECG_1", "ecg"], "x")
    assert sorted(r["label"] for r in c.collect()) == ["ECG", "ECG 1", "ECG_1", "ECG_2"]
    _, c = api.header_table(spark, ["i", "cs_1-2"], "x", adc_saturation=32768, additional_gain=[5.0, 10.0])
    assert [(r["label"], r["source"], r["lead"], r["adc_gain"]) for r in c.orderBy("number").collect()] == [("I", "ECG", "I", 6553.6), ("CS 1-2", "CS", "1-2", 3276.8)]
    with pytest.raises(ValueError):
        api.signal_table(spark, {"I": [1.0], "II": [1.0, 2.0]})


def test_unique_names_pass_over_taken_ones(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(["A", "A", "A_1", "A", None, None])], "k string, n int, l string")
    assert [r["u"] for r in make_unique(df, ["k"], "l", "n", "u").orderBy("n").collect()][:4] == ["A", "A_2", "A_1", "A_3"]


def test_units_round_and_clamp(spark):
    df = spark.createDataFrame([(0.0125, 200.0, 0, 16), (-0.0125, 200.0, 0, 16), (99.0, 6553.6, 0, 16), (99.0, 200.0, 0, 212), (1.0, None, None, 16), (3.0, 0.0, 1, 16)], "v double, g double, b int, f int")
    assert [r[0] for r in df.select(ch.to_digital(*map(F.col, "vgbf"))).collect()] == [3, -3, 32767, 2047, 200, 4]
    assert [r[0] for r in df.select(ch.to_physical(F.lit(1224), F.lit(200.0), F.lit(1024))).limit(1).collect()] == [1.0]
    assert df.filter("g = 0").select(ch.to_physical(F.lit(5), F.col("g"), F.col("b"))).first()[0] == 4.0


def test_elapsed(spark):
    df = spark.createDataFrame([(0, 250.0), (100, 250.0), (900_000 * 4, 250.0), (5, 0.0), (None, 250.0)], "s int, f double")
    assert [tuple(r) for r in df.select(elapsed(F.col("s"), F.col("f")), elapsed_short(F.col("s"), F.col("f"))).collect()] == [
        ("00:00:00.000", "00:00:00"), ("00:00:00.400", "00:00:00.4"), ("04:00:00.000", "04:00:00"), (None, ""), (None, "")]


def test_greedy_refractory(spark):
    at = [1, 50, 101, 102, 190, 203, 450, 451, 560, 700]
    df = spark.createDataFrame([("r", "I", x) for x in at + at], "record_id string, label string, sample int")
    want = []
    for x in at:
        if not want or x - want[-1] >= 100:
            want.append(x)
    assert sorted(r["sample"] for r in rhythm.apart(df, 100).collect()) == want


def test_long_and_ragged_windows(spark):
    df = spark.createDataFrame([("r", 1, "I", i, float(i)) for i in range(3)] + [("r", 2, "I", 5, 7.0), ("r", 3, "I", 1, None)], "record_id string, window_id int, label string, sample int, mv double")
    out = {k: [r["mv"] for r in waveforms.time_normalized(df, 5, k).filter("window_id = 1").orderBy("sample").collect()] for k in ("linear", "step", "spline")}
    assert out["linear"] == [0, 0.5, 1, 1.5, 2] and out["step"] == [0, 0, 1, 1, 2] and np.allclose(out["spline"], out["linear"])
    assert [r["mv"] for r in waveforms.time_normalized(df, 3).filter("window_id = 2").collect()] == [7.0] * 3 and waveforms.time_normalized(df, 3).filter("window_id = 3").count() == 0


def test_streamed_windows_are_the_batch_ones(spark, tmp_path):
    rec, n = _recording(spark)
    folder = str(tmp_path / "in")
    rec.annotations.orderBy("sample").coalesce(1).write.parquet(folder)
    a = spark.readStream.schema(rec.annotations.schema).parquet(folder)
    q = stream_windows(a, {"type": "(", "number": 0}, {"type": ")", "number": 2}, {"type": "N"}).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("streamed").collect()}
    w = api.window(rec, onset_criteria={"type": "(", "number": 0}, offset_criteria={"type": ")", "number": 2}, reference_criteria={"type": "N"}).table
    assert got == {tuple(r) for r in w.select("record_id", "window_id", "onset", "offset", "qrs").collect()} and len(got) == n - 1


@pytest.mark.parametrize("block", [1700, 1 << 18])
def test_blocks_of_long_channels(spark, block):
    x, _ = _beats(250, 40, noise=0.02, seed=3)
    short, _ = _beats(500, 4)
    rows = [("long", "I", i, float(v), 250.0) for i, v in enumerate(x)] + [("short", "I", i, float(v), 500.0) for i, v in enumerate(short)] + [("nan", "I", i, math.nan, 250.0) for i in range(9)] + [("few", "I", 1, 1.0, 250.0)]
    df = spark.createDataFrame(rows, "record_id string, label string, sample int, mv double, frequency double")
    got = waveforms.qrs(df, block=block, margin=1500)
    for name, y, f in (("long", x, 250.0), ("short", short, 500.0)):
        assert sorted(r["sample"] for r in got.filter(F.col("record_id") == name).collect()) == dsp.detect_qrs(y, f).tolist()
    assert got.select("record_id").distinct().count() == 2
    band = waveforms.filtered(df, low=5.0, high=30.0, block=block, margin=1500).filter("record_id = 'long'").orderBy("sample").collect()
    assert np.allclose([r["filtered"] for r in band], dsp.bandpass(x, 250, 5.0, 30.0), atol=1e-9)


def test_columns_that_are_there_already(spark):
    c = spark.createDataFrame([("r", 1, "I", "x", "y", 7, "z", "#1"), ("r", 2, None, "x", "y", 7, "z", "#1")], "record_id string, number int, label string, lead_group string, source string, ord int, lead string, color string")
    assert [r["color"] for r in ch.with_colors(c).orderBy("number").collect()] == ["#E3F2FD", None] and ch.with_sources(c).count() == 2 and ch.channel_source(c).columns.count("lead_group") == 1


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_upsampling_in_blocks(spark, block):
    r = np.random.default_rng(4)
    channels = {"a": (r.normal(size=23), 250.0), "b": (r.normal(size=7), 977.0), "c": (r.normal(size=5), 1000.0), "d": (np.array([2.5]), 250.0), "e": (np.array([1.0, 2.0]), 360.0)}
    df = spark.createDataFrame([(k, "I", 3 * i, float(v), f) for k, (x, f) in channels.items() for i, v in enumerate(x)], "record_id string, label string, sample int, mv double, frequency double")
    out = waveforms.upsampled(df, 1000.0, block=block)
    for k, (x, f) in channels.items():
        got = [(q["sample"], q["mv"]) for q in out.filter(F.col("record_id") == k).orderBy("sample").collect()]
        want = dsp.upsample(x, f, 1000.0) if len(x) > 1 else np.repeat(x, 4)
        assert [g[0] for g in got] == list(range(1, len(want) + 1)) and np.allclose([g[1] for g in got], want), k


def test_windowed_and_paths(spark):
    rec, _ = _recording(spark)
    table = spark.createDataFrame([("r1", 1, 10, 20)], "record_id string, window_id int, onset int, offset int")
    assert api.is_windowed(api.windowed(table, rec)) and api.windowed(table, rec).signal().count() == 33
    for bad in ((table, 3), (rec.signal, rec)):
        with pytest.raises(TypeError):
            api.windowed(*bad)
    api.set_wfdb_path("/opt/wfdb")
    assert api.find_wfdb_software() == "/opt/wfdb" and api.find_wfdb_command("rdann") == "/opt/wfdb/rdann"
    api.set_wfdb_path(None)


def test_excerpts(spark):
    x, _ = _beats(250, 20)
    df = spark.createDataFrame([("r", "I", i, float(v), 250.0) for i, v in enumerate(x)], "record_id string, label string, sample int, mv double, frequency double")
    out = {r["excerpt"]: r["dominant_frequency"] for r in waveforms.dominant_frequency(df, excerpt_s=10.0).collect()}
    assert out == {k: dsp.dominant_frequency(x[2500 * k : 2500 * (k + 1)], 250.0) for k in (0, 1)}
    assert waveforms.f_waves(df, excerpt_s=10.0).count() == 2 and waveforms.f_waves(df).count() == 1


def _long_table(spark, folder):
    """A lead of 150 s in the tables that queries read."""
    x, _ = _beats(100, 150)
    spark.createDataFrame([("r", "II", i, float(v), 0) for i, v in enumerate(x)], "record_id string, label string, sample int, mv double, batch_no int").write.parquet(f"{folder}/ggm.parquet")
    spark.createDataFrame([("r", 100.0)], "record_id string, frequency double").write.parquet(f"{folder}/records.parquet")
    return x


@pytest.mark.parametrize("method", ["adaptive_svd", "ica"])
def test_features_of_the_whole_lead(spark, tmp_path, method):
    x = _long_table(spark, tmp_path)
    query = signals.f_wave_features if method == "adaptive_svd" else signals.f_wave_features_ica
    got = query(spark, str(tmp_path)).collect()
    want = dsp.atrial_features(x, 100.0, ("amplitude", "approximate_entropy", "dominant_frequency"), method, zlib.crc32(repr(("r", "II")).encode()))
    assert len(got) == 1 and all(got[0][k] == pytest.approx(v) for k, v in want.items()) and set(want) < set(got[0].asDict())


def test_dominant_frequency_of_the_whole_channel(spark, tmp_path):
    x = _long_table(spark, tmp_path)
    got = signals.dominant_frequency(spark, str(tmp_path)).collect()
    assert [r["dominant_frequency"] for r in got] == [pytest.approx(dsp.dominant_frequency(x, 100.0), abs=1e-8)]


def _phi(x, m, r):
    v = np.lib.stride_tricks.sliding_window_view(x, m)
    return np.mean([math.log(np.mean(np.abs(v - w).max(axis=1) <= r)) for w in v])


def test_entropy_of_whole_channels(spark, tmp_path):
    x = _long_table(spark, tmp_path)[:1500]
    table = spark.read.parquet(f"{tmp_path}/ggm.parquet").filter("sample < 1500")
    table.write.parquet(f"{tmp_path}/short/ggm.parquet")
    got = signals.approx_entropy_channels(spark, f"{tmp_path}/short").collect()
    r = 3.5 * x.std(ddof=1)
    assert [q["approximate_entropy"] for q in got] == [pytest.approx(_phi(x, 3, r) - _phi(x, 4, r), abs=1e-9)]
    for r in (0.05, 1.0):
        blocks = waveforms.approximate_entropy(table, 3, r, block=400).collect()
        assert [q["approximate_entropy"] for q in blocks] == [pytest.approx(_phi(x, 3, r) - _phi(x, 4, r), abs=1e-12)]
    few = spark.createDataFrame([("a", "I", i, 1.0) for i in range(3)] + [("b", "I", i, math.nan) for i in range(9)], "record_id string, label string, sample int, mv double")
    assert [q["approximate_entropy"] for q in waveforms.approximate_entropy(few).orderBy("record_id").collect()] == [None, 0.0]


@pytest.mark.parametrize("kind", ["noise", "steps", "smooth", "spikes", "flat"])
def test_boxes_and_pairs_count_the_same(kind):
    g = np.random.default_rng(11)
    n = 900
    x = {
        "noise": g.normal(size=n), "steps": g.integers(0, 6, n) * 0.1, "smooth": np.convolve(g.normal(size=n + 49), np.ones(50) / 50, "valid"),
        "spikes": g.integers(-20, 20, n) * 0.005 + np.where(g.random(n) < 0.02, g.choice([-9.0, 0.4, 0.9, 9.0], n), 0), "flat": np.full(n, 0.7),
    }[kind]
    for m, r in ((3, 3.5 * x.std(ddof=1)), (2, 0.3), (1, 0.1), (4, 0.0)):
        want = [dsp._pair_counts(x, k, r, 512) for k in (m, m + 1)]
        assert all((a == b).all() for a, b in zip(dsp.near_counts(x, m, r), want, strict=True))
        for parts in (1, 3):
            made = [dsp.near_counts(x, m, r, 0, part, parts) for part in range(parts)]
            assert all((np.sort(np.concatenate([c[j] for c in made])) == np.sort(want[j])).all() for j in (0, 1))


def test_entropy_of_a_long_lead_is_not_quadratic():
    """200,000 readings in steps of the converter with bad readings among them: all pairs would take minutes."""
    g = np.random.default_rng(12)
    t = np.arange(200_000)
    x = np.round(0.1 * np.sin(t / 40) + np.where(t % 200 < 4, 0.9, 0) + g.normal(0, 0.02, len(t)), 2)
    x[g.integers(0, len(t), 200)] = g.uniform(-30, 30, 200)
    began = time.process_time()
    some, more = dsp.near_counts(x, 3, 3.5 * x.std(ddof=1))
    assert time.process_time() - began < 10 and len(some) == len(t) - 2 and len(more) == len(t) - 3
    row = waveforms._entropy_rows(x, 3, None, 1 << 12, {})
    assert {r["_parts"] for r in row[1:]} == {7}  # copies of the channel: the root of its 49 blocks


def test_copies_of_a_reading_count_once(spark):
    rows = [("r", "I", i, float(i % 3), 100.0) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:20], "record_id string, label string, sample int, mv double, frequency double")
    x = np.array([v[3] for v in rows])
    assert waveforms.approximate_entropy(df, 2, 0.5).first()["approximate_entropy"] == pytest.approx(dsp.approximate_entropy(x, 2, 0.5), abs=1e-12)
    assert waveforms.dominant_frequency(df, 1.0, 50.0).first()["dominant_frequency"] == dsp.dominant_frequency(x, 100.0, 1.0, 50.0)


def test_missing_readings_keep_their_place(spark):
    """Nan, infinite, null and impossible readings: nothing is compared with them, filters and sums read 0 there."""
    x = [0.0, 1.0, 0.5, math.nan, 2.0, 1.0, 99.0, 3.0, 0.0, None, 4.0, math.inf, 0.0]
    df = spark.createDataFrame([("r", "I", i, v, 100.0) for i, v in enumerate(x)], "record_id string, label string, sample int, mv double, frequency double")
    y = np.array([v if v is not None and abs(v) <= 50 else 0.0 for v in x])
    assert sorted(r["sample"] for r in rhythm.find_peaks(df, factor=-9.0).collect()) == [1]
    got = [r["integral"] for r in rhythm.moving_integral(df, "mv", 3).orderBy("sample").collect()]
    assert np.allclose(got, [y[max(0, i - 2) : i + 1].sum() / 3 for i in range(len(y))])
    by_rate = [r["integral"] for r in rhythm.moving_integral_s(df, "mv", 0.025).orderBy("sample").collect()]
    assert np.allclose(by_rate, [y[max(0, i - 1) : i + 1].sum() / 2 for i in range(len(y))])  # 2.5 readings: half to even
    slope = [r["slope"] for r in rhythm.derivative(df).orderBy("sample").collect()]
    p = np.r_[np.zeros(4), y]
    assert np.allclose(slope, (-p[4:] - 2 * p[3:-1] + 2 * p[1:-3] + p[:-4]) * 100 / 8)
    band = [r["filtered"] for r in waveforms.filtered(df, low=5.0, high=30.0).orderBy("sample").collect()]
    assert np.allclose(band, dsp.bandpass(y, 100.0, 5.0, 30.0))
    up = [r["mv"] for r in waveforms.upsampled(df.filter("sample < 5"), 200.0).orderBy("sample").collect()]
    assert len(up) == 10 and up[0] == 0.0 and up.count(None) > 2 and up[-1] == 2.0


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
def test_greedy_choice_over_ranges(spark, width):
    r = np.random.default_rng(width)
    at = {k: np.unique(r.integers(0, 900, n)).tolist() for k, n in (("a", 400), ("b", 3), ("c", 90))}
    df = spark.createDataFrame([(k, "I", int(x)) for k, v in at.items() for x in v], "record_id string, label string, sample int")
    for step in (1, 10, 200):
        got = rhythm.apart(df, step, width=width).collect()
        for k, v in at.items():
            want = []
            for x in v:
                if not want or x - want[-1] >= step:
                    want.append(x)
            assert sorted(q["sample"] for q in got if q["record_id"] == k) == want


def test_standardized_windows_may_stay_windows(spark):
    rec, n = _recording(spark)
    w = api.window(rec, onset_criteria={"type": "(", "number": 0}, offset_criteria={"type": ")", "number": 2}, reference_criteria={"type": "N"})
    std = api.standardize_windows(w, 20, preserve_class=True)
    assert api.is_windowed(std) and std.method == "standardized_time_normalize"
    assert std.signal().count() == 20 * 3 * (n - 1) and std.source.channels.count() == 3 * (n - 1)
    with pytest.warns(UserWarning):
        lacking = api.standardize_windows(w, 20, align_feature="V", preserve_amplitude=False)
    assert {tuple(r) for r in lacking.collect()} == {tuple(r) for r in api.standardize_windows(w, 20, preserve_amplitude=False).collect()}
    with pytest.raises(ValueError):
        api.standardize_windows(w, method="none")
    with pytest.raises(TypeError):
        api.standardize_windows(rec)


def test_windows_are_numbered_on_over_tables_and_ranges(spark):
    from leadframe.operators import annotations as ann

    schema = "record_id string, window_id int, onset int, offset int"
    a = spark.createDataFrame([("r", 1, 5, 9), ("r", 2, 70_000, 70_010), ("s", 1, 1, 2)], schema)
    b = spark.createDataFrame([("r", 4, 200_000, 200_001), ("r", 3, 3, 4), ("r", 2, 3, 4)], schema)
    got = sorted((r["record_id"], r["window_id"], r["onset"]) for r in ann.concat_windows(a, b).collect())
    assert got == [("r", 1, 5), ("r", 2, 70_000), ("r", 3, 3), ("r", 4, 3), ("r", 5, 200_000), ("s", 1, 1)]


def test_bounds_that_overlap_go_to_the_last_onset(spark):
    from leadframe.operators import annotations as ann

    s = spark.createDataFrame([("r", i) for i in range(0, 1200, 100)] + [("r", 100), ("q", 5)], "record_id string, sample int")
    b = spark.createDataFrame([("r", "p", "p1", 0, 1000), ("r", "qrs", "qrs1", 300, 600), ("r", "t", "t1", 600, None)], "record_id string, wave string, beat string, onset int, offset int")
    got = sorted((r["record_id"], r["sample"], r["beat"]) for r in ann.in_waves(s, b).collect() if r["beat"])
    assert got == sorted([("r", i, "qrs1" if 300 <= i < 600 else "p1") for i in range(0, 1000, 100)] + [("r", 100, "p1")]) and ann.in_waves(s, b).count() == 14


def test_headers_take_what_users_give(spark):
    r, c = api.header_table(spark, ["I", "II"], "x", adc_zero=[1, 2], low_pass=30, high_pass=[250, 500], scale=-6, storage_format=[16, 24], info_strings={"note": ["a", 1]}, number_of_channels=0)
    assert [(x["adc_baseline"], x["initial_value"], x["low_pass"], x["high_pass"], x["scale"], x["storage_format"]) for x in c.orderBy("number").collect()] == [(1, 1, 30, 250, -6, 16), (2, 2, 30, 500, -6, 24)]
    assert r.first()["number_of_channels"] == 2 and [(x["key"], x["values"]) for x in r.first()["info"]] == [("note", ["a", "1"])]
    with pytest.raises(ValueError):
        api.header_table(spark, ["I"], info_strings={"": ["x"]})
    s = api.signal_table(spark, [("ECG", [1.0]), ("ECG", [2.0]), ("ECG_1", [3.0])])
    assert sorted((x["label"], x["value"]) for x in s.collect()) == [("ECG", 1.0), ("ECG_1", 3.0), ("ECG_2", 2.0)]
    assert [x["color"] for x in ch.with_colors(c.select("record_id", "number", "label"), palette={"ECG": ["#000001", "#000002"]}).orderBy("number").collect()] == ["#000001", "#000002"]
