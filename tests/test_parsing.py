from __future__ import annotations

import csv
import io
import sys

from leadframe.operators import parsing

csv.field_size_limit(sys.maxsize)

LINES = [
    'rec_1,12,5000,1000 Hz,10:00:00,note', '"rec ""1""",12,5000 00:00:05,1000Hz,10:00:00,"a, b"', "rec,0,5000,1000,,", "rec,513,5000,1000,,", "rec,512,1,0.5,,", "rec,12,0,1000,,", "rec,12,5000 00:60:00,1000,,",
    "rec,12,5000,0,,", "rec,12,5000,1000  Hz,,", "rec,12,5000,1000 points/second,,", "rec,12,5000,1000 hz,,", "rec,12,5000,1000", "", 'a"b,1,1,1,,', '"a,1,1,1,,', '"a" ,1,1,1,,', 'r,1,1,1,,"x', "rec, 012 ,\t7\t, 9.5 Hz ,,",
    "rec,+1,5,1,,", "rec,1,5.0,1,,", "rec,1,5,1e3,,", ",1,5,1,,", "rec,1,5,1,,,", None, 'r,1,' + "9" * 60 + ",1,,", "r,1,5,1,," + "x" * 200_000, 'r,1,5,1,,"' + '""' * 50_000 + '"', "r,٣,5,1,,",
]
WANT = {
    2: "value", 3: "value", 5: "value", 6: "value", 7: "value", 8: "value", 10: "value", 11: "columns", 12: "columns", 13: "quoting", 14: "quoting", 15: "quoting", 16: "quoting", 18: "value", 19: "value", 20: "value",
    22: "columns", 23: "columns", 27: "value",
}


def _table(spark, lines):
    return spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(lines)], "raw_id bigint, raw_text string, channels int")


def test_reasons(spark):
    t = _table(spark, LINES)
    t = t.unionByName(t.limit(5))  # delivered again
    fmt = parsing.header_log(",")
    assert {r["raw_id"]: r["reason"] for r in parsing.rejected(t, fmt).collect()} == WANT
    loaded = {r["raw_id"]: r for r in parsing.strict_load(t, fmt).collect()}
    assert set(loaded) | set(WANT) == set(range(len(LINES))) and not set(loaded) & set(WANT)
    assert (loaded[1]["record_name"], loaded[1]["samples"], loaded[1]["note"]) == ('rec "1"', 5000, "a, b")
    assert (loaded[17]["channels"], loaded[17]["samples"], loaded[17]["rate"]) == (12, 7, 9.5)


def test_numbers_beyond_their_type_do_not_stop_the_load(spark, tmp_path):
    from leadframe.plans import problems

    lines = ["r,1," + "9" * 30 + ",1,,", "r,1,00" + "9" * 60 + ",1,,", "r,1,0007,1,,"]
    for log, s in (("bard", ","), ("prucka", ";")):
        spark.createDataFrame([(i, x.replace(",", s)) for i, x in enumerate(lines)], "raw_id bigint, raw_text string").write.parquet(f"{tmp_path}/{log}.parquet")
    got = {(r["log"], r["raw_id"]): (r["samples"], r["samples_text"]) for r in problems.p3_loaded(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(got[log, i] == w for log in ("bard", "prucka") for i, w in enumerate([(None, "9" * 30), (None, "9" * 60), (7, "7")]))
    assert problems.p3_found(spark, str(tmp_path)).count() == 0


def test_fields_as_a_csv_reader_has_them(spark):
    loaded = parsing.strict_load(_table(spark, LINES), parsing.header_log(",")).collect()
    for r in loaded:
        fields = next(csv.reader(io.StringIO(LINES[r["raw_id"]])))
        assert r["record_name"] == fields[0].strip(" \t") and r["note"] == fields[5].strip(" \t")


def test_semicolons_and_empty(spark):
    t = _table(spark, ["r;1;5;977 points/second;4/1/2020 2:00:00 AM;a, b", "r;1;5;977,4;x;y"])
    assert [r["reason"] for r in parsing.rejected(t, parsing.header_log(";")).collect()] == ["value"]
    assert parsing.rejected(t.limit(0), parsing.header_log(";")).count() == 0
