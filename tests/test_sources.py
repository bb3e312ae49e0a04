"""Byte-level vectors, round trips and vendor files; all content is made up."""

from __future__ import annotations

import base64
import datetime as dt
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadframe import api
from leadframe.sources import vendors, wfdb
from leadframe.sources import wfdb_format as fmt


def test_known_bytes():
    assert fmt.decode(bytes([0x18, 0xCF, 0xF4]), [212, 212]).tolist() == [[-232, -780]]
    assert fmt.decode(b"\xff\xff\x00\x80", [16, 16]).tolist() == [[-1, -32768]]
    assert fmt.decode(b"\xff\xff\x7f", [24]).tolist() == [[8388607]]
    assert fmt.decode(b"\x00\x00\x00\x80", [32]).tolist() == [[-2147483648]]
    assert fmt.decode(b"\x80", [80]).tolist() == [[-128]]
    for bad in ([212], [212, 16], [311]):
        with pytest.raises(ValueError):
            fmt.layout(bad)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_every_format_round_trips(data):
    formats = []
    for f in data.draw(st.lists(st.sampled_from([8, 80, 16, 24, 32, 212]), min_size=1, max_size=4)):
        formats += [212, 212] if f == 212 else [f]
    frames = data.draw(st.lists(st.tuples(*[st.integers(*fmt.LIMITS[f]) for f in formats]), max_size=6))
    counts = np.array(frames, np.int64).reshape(len(frames), len(formats))
    assert (fmt.decode(fmt.encode(counts, formats), formats) == counts).all()


def test_counts_are_held_in_range():
    assert fmt.decode(fmt.encode(np.array([[5000, -5000]]), [212, 212]), [212, 212]).tolist() == [[2047, -2048]]


def test_annotation_opcodes():
    w = lambda code, value: bytes((value & 0xFF, code << 2 | value >> 8))
    skip = w(59, 0) + struct.pack("<HH", 1, 5)
    data = w(1, 100) + w(61, 3) + w(62, 2) + w(60, 7) + w(5, 20) + skip + w(39, 4) + w(63, 3) + b"abc\0" + w(50, 1) + b"\0\0" + w(1, 9)
    got = [tuple(m.values()) for m in fmt.decode_annotations(data)]
    assert got == [(100, "N", 3, 2, 7), (120, "V", 0, 0, 0), (120 + 65541 + 4, "(", 0, 0, 0), (120 + 65541 + 5, "?", 0, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400_000), st.sampled_from(["N", "V", "(", ")", "p", "t", "/", '"']), st.integers(0, 1023), st.integers(0, 1023), st.integers(0, 1023)), max_size=12))
def test_annotations_round_trip(rows):
    marks = [dict(zip(("sample", "type", "subtype", "channel", "number"), r, strict=True)) for r in rows]
    assert fmt.decode_annotations(fmt.encode_annotations(marks)) == sorted(marks, key=lambda m: m["sample"])


def test_annotations_refused():
    for bad in ({"sample": 3, "type": "§"}, {"sample": 0, "type": ""}, {"sample": 1, "type": "N", "number": 1024}):
        with pytest.raises(ValueError):
            fmt.encode_annotations([bad])


def _recording(spark, n=50, name="rec"):
    r = random.Random(1)
    cols = {"I": [r.randrange(-2000, 2000) for _ in range(n)], "V1": [r.randrange(-2000, 2000) for _ in range(n)]}
    records, channels = api.header_table(spark, ["I", "v1"], name, 250.0, n, dt.datetime(2021, 3, 4, 5, 6, 7), adc_gain=[200.0, 698.0], adc_baseline=[1024, -5])
    marks = [{"sample": i, "type": t, "number": k} for i, t, k in ((5, "(", 0), (7, "p", 0), (9, ")", 0), (9, "(", 1), (12, "N", 0), (2000, ")", 1))]
    return api.recording(api.signal_table(spark, {"sample": list(range(n)), **cols}, name), records, channels, api.annotation_table(spark, marks, "atr", name, 250.0)), cols


def test_write_and_read_again(spark, tmp_path):
    rec, cols = _recording(spark)
    folder = str(tmp_path / "out")
    assert [tuple(r) for r in api.write_wfdb(rec, record_dir=folder).collect()] == [("rec", f"{folder}/rec.hea", 50)]
    assert api.write_annotation(rec.annotations, "atr", record_dir=folder).first()["marks"] == 6
    back = api.read_wfdb(spark, "rec", folder, "atr")
    got = {k: [r["value"] for r in back.signal.filter(F.col("label") == k).orderBy("sample").collect()] for k in cols}
    assert got == cols
    h = {r["label"]: r for r in back.channels.collect()}
    assert (h["V1"]["adc_gain"], h["V1"]["adc_baseline"], h["V1"]["storage_format"]) == (698.0, -5, 16)
    assert back.records.first()["start_time"] == dt.datetime(2021, 3, 4, 5, 6, 7)
    marks = sorted((r["sample"], r["type"], r["number"]) for r in back.annotations.collect())
    assert marks == sorted((r["sample"], r["type"], r["number"]) for r in rec.annotations.collect())
    assert sorted(r["time"] for r in back.annotations.filter("sample = 12").collect()) == ["00:00:00.048"]


def test_ranges_channels_units(spark, tmp_path):
    rec, cols = _recording(spark)
    folder = str(tmp_path)
    api.write_wfdb(rec, record_dir=folder)
    part = api.read_signal(spark, "rec", folder, begin=0.04, end=0.08, channels=["v1", 1, "V1"])
    assert sorted({r["sample"] for r in part.collect()}) == list(range(10, 20)) and part.count() == 30
    physical = api.read_signal(spark, "rec", folder, units="physical", channels=["I"]).orderBy("sample").collect()
    assert abs(physical[3]["value"] - (cols["I"][3] - 1024) / 200) < 1e-12
    assert wfdb.read_signal(spark, folder, ["rec"], frames=7).count() == 100
    assert wfdb.read_signal(spark, folder).filter("sample >= 45 and sample < 48").count() == 6
    assert api.read_signal(spark, "rec", folder, begin=0.1, interval=0.02, end=9).count() == 10
    with pytest.raises(Exception, match="no such channel"):
        api.read_signal(spark, "rec", folder, channels=["V9"]).count()
    with pytest.raises(FileNotFoundError, match="none not found"):
        api.read_header(spark, "none", folder)


def test_physical_values_come_back(spark, tmp_path):
    rec, cols = _recording(spark)
    folder = str(tmp_path)
    scaled = {"I": [v / 100 for v in range(-25, 25)], "V1": [v / 50 for v in range(-25, 25)]}
    api.write_wfdb(api.recording(api.signal_table(spark, {"sample": list(range(50)), **scaled}, "rec"), rec.records, rec.channels), record_dir=folder, units="physical")
    back = api.read_signal(spark, "rec", folder, units="physical").collect()
    assert all(abs(r["value"] - scaled[r["label"]][r["sample"]]) <= 0.5 / 200 + 1e-9 for r in back)


def test_header_text_with_gaps(spark, tmp_path):
    (tmp_path / "odd.hea").write_text("odd 3 360 0 10:20:30 05/04/2021\n\nodd.dat 212 296\nodd.dat 212 x(7)/uV 11 z 0 0 0 ECG one\n\nodd.dat 16 200(0)/mV 12 0 0 0 0\n# source A B\n# one line of prose\n")
    records, channels = wfdb.read_headers(spark, str(tmp_path))
    r = records.first()
    assert (r["frequency"], r["number_of_channels"], r["start_time"]) == (360.0, 3, dt.datetime(2021, 4, 5, 10, 20, 30))
    assert [(x["key"], x["values"]) for x in r["info"]] == [("source", ["A", "B"]), ("one", ["line", "of", "prose"])]
    c = channels.orderBy("number").collect()
    assert [(x["adc_gain"], x["adc_baseline"], x["adc_units"], x["adc_zero"], x["label"]) for x in c] == [(296.0, None, "mV", None, "CH1"), (None, 7, "uV", None, "ECG ONE"), (200.0, 0, "mV", 0, "CH3")]


def test_bard(spark, tmp_path):
    head = ["Export"] + [f"x{i}: y" for i in range(8)] + ["Channels exported: 2", "Samples per channel: 300:00:01", "Start time: 10:11:12", "Sample Rate: 1000Hz"]
    per = [[f"Channel #: {i}", f"Label: {name}", "Range: 5mv", "Low: 30Hz", "High: 250Hz", "Sample rate: 1000Hz", "Color: FF0000", "Scale: -6"] for i, name in ((1, "I"), (2, "cs_1-2"))]
    (tmp_path / "log.txt").write_text("\n".join([*head, *per[0], *per[1], "", "[Data]", "1,2", "3,4", "5,6"]) + "\n")
    records, channels, signal = vendors.read_bard(spark, str(tmp_path / "log.txt"), 2)
    r = records.first()
    assert (r["number_of_channels"], r["samples"], r["frequency"], r["count_mismatch"]) == (2, 3, 1000.0, False)
    assert [(c["label"], c["adc_gain"], c["low_pass"], c["color"]) for c in channels.orderBy("number").collect()] == [("I", 6553.6, 30.0, "#FF0000"), ("CS 1-2", 6553.6, 30.0, "#FF0000")]
    assert sorted(tuple(x)[1:] for x in signal.collect()) == [(1, "CS 1-2", 2.0), (1, "I", 1.0), (2, "CS 1-2", 4.0), (2, "I", 3.0)]


def test_prucka(spark, tmp_path):
    inf = "Patient = X\nNumber of Channel = 3\nPoints for Each Channel = 2\nData Sampling Rate = 977 points/second\nStart Time = 7/26/2024 10:02:58 AM\nUnits: mV\nChannel Number  Channel Label\n50             CS\n1              I\n5              V1\n\n"
    (tmp_path / "p.inf").write_text(inf)
    (tmp_path / "p.txt").write_text("1 2 3\n 4 5 6 \n")
    records, channels, signal = vendors.read_prucka(spark, str(tmp_path / "p.txt"))
    assert (records.first()["frequency"], records.first()["start_time"]) == (977.0, dt.datetime(2024, 7, 26, 10, 2, 58))
    assert [c["label"] for c in channels.orderBy("number").collect()] == ["I", "V1", "CS"]
    assert sorted(tuple(x)[1:] for x in signal.filter("sample = 2").collect()) == [(2, "CS", 6.0), (2, "I", 4.0), (2, "V1", 5.0)]
    with pytest.raises(FileNotFoundError):
        vendors.read_prucka(spark, str(tmp_path / "q.txt"))


def test_muse(spark, tmp_path):
    lead = lambda name, v: f"<LeadData><LeadID>{name}</LeadID><LeadSampleCountTotal>3</LeadSampleCountTotal><LeadAmplitudeUnitsPerBit>4.88</LeadAmplitudeUnitsPerBit><WaveFormData>{base64.b64encode(struct.pack('<3h', *v)).decode()}</WaveFormData></LeadData>"
    wave = "<Waveform><SampleBase>500</SampleBase>" + lead("I", (1, -2, 3)) + lead("II", (10, 20, -32768)) + lead("V1", (5, 6, 7)) + "</Waveform>"
    xml = f"<RestingECG><PatientDemographics><PatientID>7</PatientID><PatientAge>50</PatientAge></PatientDemographics><TestDemographics><AcquisitionDate>02-19-2022</AcquisitionDate><AcquisitionTime>16:53:08</AcquisitionTime></TestDemographics><Diagnosis><DiagnosisStatement><StmtFlag>ENDSLINE</StmtFlag><StmtText>Sinus rhythm</StmtText></DiagnosisStatement></Diagnosis><Waveform><SampleBase>1</SampleBase></Waveform>{wave}</RestingECG>"
    (tmp_path / "m.xml").write_text(xml)
    records, channels, signal = vendors.read_muse(spark, str(tmp_path))
    r = records.first()
    info = {x["key"]: x["values"][0] for x in r["info"]}
    assert (r["frequency"], r["start_time"], info["mrn"], info["diagnosis"]) == (500.0, dt.datetime(2022, 2, 19, 16, 53, 8), "7", "Sinus rhythm")
    v = {(x["label"], x["sample"]): x["value"] for x in signal.collect()}
    i, ii = 3 * 4.88, -32768 * 4.88
    assert np.allclose([v["III", 3], v["AVR", 3], v["AVL", 3], v["AVF", 3], v["V1", 1]], [ii - i, -(i + ii) / 2, i - ii / 2, ii - i / 2, 5 * 4.88])
    assert channels.count() == 12


def test_written_labels_have_a_channel(spark, tmp_path):
    """Samples under a label of their own are written to the channel left over, never as zeros; without one it is an error."""
    records, channels = api.header_table(spark, ["I", "ECG II"], "r", 250.0, 3)
    write = lambda labels, k: wfdb.write_records(api.signal_table(spark, {"sample": [0, 1, 2]} | {x: [float(10 * i + j) for j in range(1, 4)] for i, x in enumerate(labels)}, "r"), records, channels, str(tmp_path / k))
    write(["I", "II"], "a")
    got = {r["label"]: r["v"] for r in wfdb.read_signal(spark, str(tmp_path / "a")).groupBy("label").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()}
    assert sorted(got.values()) == [[1, 2, 3], [11, 12, 13]]
    for bad in (["V1", "V2"], ["I", "ECG II", "V1"]):
        with pytest.raises(ValueError):
            write(bad, "b")


def _frames(spark, folder):
    return {(r["record_id"], r["label"]): r["v"] for r in wfdb.read_signal(spark, folder).groupBy("record_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("v")).collect()}


@pytest.mark.parametrize("labels", [["ECG", "ECG", "ECG_1"], [None, "", None], ["I", None, "I"]])
def test_repeated_and_blank_labels_keep_their_channels(spark, tmp_path, labels):
    (tmp_path / "r.hea").write_text("\n".join(["r 3 250 0", *(f"r.dat\t16\t200/mV\t12\t0\t0\t0\t0\t{x or ''}" for x in labels)]) + "\n")
    counts = np.array([[1, 10, 100], [2, 20, 200]])
    (tmp_path / "r.dat").write_bytes(fmt.encode(counts, [16] * 3))
    rec = api.read_wfdb(spark, "r", str(tmp_path))
    names = [c["label"] for c in rec.channels.orderBy("number").collect()]
    assert len(set(names)) == 3 and names == wfdb.own_labels(labels)
    assert _frames(spark, str(tmp_path)) == {("r", n): [float(v) for v in counts[:, i]] for i, n in enumerate(names)}
    wide = api.extract_signal(rec).orderBy("sample").collect()
    assert [[r[n] for n in names] for r in wide] == counts.tolist()
    out = str(tmp_path / "out")
    assert [tuple(r)[::2] for r in api.write_wfdb(rec, record_dir=out).collect()] == [("r", 2)]
    assert sorted(_frames(spark, out).values()) == sorted([float(v) for v in counts[:, i]] for i in range(3))


def test_own_labels():
    assert wfdb.own_labels(["ecg", "ECG", "ECG 1", "ecg", "a_b", None, " "]) == ["ECG", "ECG_1", "ECG 1", "ECG_2", "A B", "CH6", "CH7"]
    assert wfdb.own_labels(["A", "A", "A"]) == ["A", "A_1", "A_2"] and wfdb.own_labels([]) == []


def test_columns_go_by_label_then_by_place_else_stop(spark, tmp_path):
    header = api.header_table(spark, ["I", "II"], "r", 250.0)
    wide = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, None)], "sample int, b double, a double")
    assert api.write_wfdb(wide, record_dir=str(tmp_path / "place"), header=header).first()["frames"] == 2
    assert _frames(spark, str(tmp_path / "place")) == {("r", "I"): [1.0, 2.0], ("r", "II"): [10.0, 0.0]}
    api.write_wfdb(wide.toDF("sample", "II", "I"), "named", str(tmp_path / "label"), header, {"note": ["x", 1]})
    assert _frames(spark, str(tmp_path / "label")) == {("named", "I"): [10.0, 0.0], ("named", "II"): [1.0, 2.0]}
    assert "# note x 1" in (tmp_path / "label" / "named.hea").read_text() and (tmp_path / "label" / "named.hea").read_text().startswith("named 2 250 2")
    for bad in (wide.select("sample", "a"), wide.select("sample"), wide.withColumn("c", F.lit(1.0))):
        with pytest.raises(ValueError):
            api.write_wfdb(bad, record_dir=str(tmp_path / "bad"), header=header)
    with pytest.raises(ValueError):
        api.write_wfdb(wide, record_dir=str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        api.write_wfdb(wide, record_dir=str(tmp_path / "bad"), header=header, info_strings={"": ["x"]})
    rec, _ = _recording(spark)
    with pytest.warns(UserWarning):
        api.write_wfdb(rec, record_dir=str(tmp_path / "own"), header=header)


def test_odd_values_are_written_as_zero_or_held(spark, tmp_path):
    records, channels = api.header_table(spark, ["I"], "r", 250.0, adc_gain=0.0, adc_baseline=3)
    s = spark.createDataFrame([("r", i, "I", v) for i, v in enumerate([1.5, -2.5, float("nan"), float("inf"), None, 1e12, -1e12])], "record_id string, sample int, label string, value double")
    wfdb.write_records(s, records, channels, str(tmp_path / "d"))
    assert _frames(spark, str(tmp_path / "d")) == {("r", "I"): [2, -3, 0, 0, 0, 32767, -32768]}
    wfdb.write_records(s.limit(2), records, channels, str(tmp_path / "p"), "physical")
    assert _frames(spark, str(tmp_path / "p")) == {("r", "I"): [5, 1]}  # 4.5 and 0.5, away from zero


def test_folders_by_uri_and_no_parts_left(spark, tmp_path):
    rec, cols = _recording(spark)
    folder = (tmp_path / "by uri").as_uri().replace("%20", "_")
    api.write_wfdb(rec, record_dir=folder)
    api.write_annotation(rec.annotations, "atr", record_dir=folder)
    back = api.read_wfdb(spark, "rec", folder, "atr", channels=["V1"])
    assert [r["value"] for r in back.signal.orderBy("sample").collect()] == cols["V1"] and back.annotations.count() == 6
    assert not [x for x in (tmp_path / "by_uri").iterdir() if x.name.endswith(".part")]


def test_lines_of_a_file_read_in_pieces(spark, tmp_path):
    text = "".join(f"line {i}\r\n" for i in range(5000))
    (tmp_path / "big.txt").write_text(text, newline="")
    (tmp_path / "other.txt").write_text("a\nb")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = vendors._lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {(r["no"], r["line"]) for r in got if r["record_id"] == "big"} == {(i, f"line {i}") for i in range(5000)} and {(r["no"], r["line"]) for r in got if r["record_id"] == "other"} == {(0, "a"), (1, "b")}


def test_tables_combined(spark):
    a = spark.createDataFrame([(1, "x")], "sample int, type string")
    b = spark.createDataFrame([(2.5, 7)], "sample double, number int")
    assert sorted(tuple(r) for r in api.combine(a, b).select("sample", "type", "number").collect()) == [(1.0, "x", None), (2.5, None, 7)]
    with pytest.raises(TypeError):
        api.combine(a, b.withColumnRenamed("number", "type"))
    with pytest.raises(TypeError):
        api.combine(a, 3)
