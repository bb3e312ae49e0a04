from __future__ import annotations

import unicodedata

import pytest

from leadframe.llm import leakage, pii
from leadframe.llm import queries as q
from leadframe.sources.tables import table
from tests.compare import differences, duck
from tests.conftest import TINY


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, TINY, "documents", "doc_id", "text").distinct().collect()}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, con, name):
    _, _, extra, missing = differences(q.QUERIES[name](spark, TINY), con, q.SQL[name])
    assert not extra and not missing


def test_what_has_no_sql():
    assert set(q.QUERIES) - set(q.SQL) == {"p8_clean", "p9_mix", "p9_shares", "p10_found", "p10_redacted"}


def test_clean_texts_share_nothing_any_more(spark, texts):
    items = [(r["item_id"], r["text"]) for r in table(spark, TINY, "bench_items", "item_id", "text").collect()]
    p = leakage.Passages(items, 13)
    clean = {r["doc_id"]: r for r in q.p8_clean(spark, TINY).collect()}
    leaked = {r["doc_id"] for r in q.p8_found(spark, TINY).collect()}
    assert clean.keys() == texts.keys() and leaked and {i for i, r in clean.items() if r["removed_chars"]} == leaked
    for i, r in clean.items():
        if i not in leaked:
            assert r["clean_text"] == texts[i] and not r["dropped"]
        elif not r["dropped"]:
            assert not p.hits(leakage.plain_words(r["clean_text"])) and "[removed]" in r["clean_text"]
            assert r["removed_chars"] <= len(unicodedata.normalize("NFC", texts[i])) / 2


def test_mix_and_its_shares(spark, texts):
    mixed = {r["doc_id"]: r for r in q.p9_mix(spark, TINY).collect()}
    targets = {r["source"]: r for r in table(spark, TINY, "mix_targets").collect()}
    assert mixed.keys() == texts.keys() and all(0 <= r["copies"] <= targets[r["source"]]["max_repeats"] for r in mixed.values() if r["source"] in targets)
    taken = {s: sum(r["copies"] * r["n_tokens"] for r in mixed.values() if r["source"] == s) for s in targets}
    # Whole documents: the longest one of every source may be too much or too little.
    slack = sum(max(r["n_tokens"] for r in mixed.values() if r["source"] == s) for s in targets) / sum(taken.values())
    for r in q.p9_shares(spark, TINY).collect():
        if r["source"] in targets:
            share = taken[r["source"]] / sum(taken.values())
            assert r["actual_share"] == pytest.approx(share) and abs(share - targets[r["source"]]["target_share"]) <= slack


def test_redacted_texts_have_what_was_found(spark, texts):
    found = {(r["doc_id"], r["pii_kind"], r["start_char"]) for r in q.p10_found(spark, TINY).collect()}
    assert found == {(i, s.kind, s.start) for i, t in texts.items() for s in pii.find(t)} and len(found) > 10
    redacted = {r["doc_id"]: r for r in q.p10_redacted(spark, TINY).collect()}
    assert redacted.keys() == texts.keys() and sum(r["n_spans"] for r in redacted.values()) == len(found)
    for i, r in redacted.items():
        kinds = [k for d, k, _ in found if d == i]
        assert (r["clean_text"] == texts[i]) == (not kinds)
        assert all(r["clean_text"].count(f"[{k.upper()}]") == kinds.count(k) for k in set(kinds))


def test_converters_give_every_reading(spark, con):
    """Channels with typed labels ('ECG II') count, with the gain of their own header."""
    from leadframe.plans import signals

    counts, readings = signals.counts(spark, TINY), signals.readings(spark, TINY)
    assert q.digital_to_physical_all(spark, TINY).count() == counts.count() and q.physical_to_digital_all(spark, TINY).count() == readings.count()
    c = spark.createDataFrame([("r", 1, "ECG II", 100.0, 5, 16), ("r", 2, "v1", 50.0, None, 212), ("r", 3, "V 01", 7.0, 3, 16)], "record_id string, number int, label string, adc_gain double, adc_baseline int, storage_format int")
    meant = spark.createDataFrame([("ECG II", "II"), ("V 01", "V1"), ("n/c", None)], "label string, canonical string")
    got = {r["label"]: (r["gain"], r["base"]) for r in q.ch.scales(c, meant).collect()}
    assert got == {"II": (100.0, 5), "V1": (50.0, 3)}
    assert {r["label"] for r in q.ch.scales(c).collect()} == {"ECG II", "V1", "V 01"}
