"""Every core query with SQL against DuckDB on the smallest tables; the others against the kernels, lead by lead."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.functions import dsp
from leadframe.operators import channels as ch
from leadframe.plans import exchange, problems, signals
from tests.compare import differences, duck
from tests.conftest import TINY

QUERIES, SQL = {**signals.QUERIES, **exchange.QUERIES, **problems.QUERIES}, {**signals.SQL, **exchange.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    _, _, extra, missing = differences(QUERIES[name](spark, TINY), con, SQL[name])
    assert not extra and not missing


def test_only_cancellation_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"f_wave_features", "f_wave_features_ica"}


@pytest.mark.parametrize(("name", "method"), [("f_wave_features", "adaptive_svd"), ("f_wave_features_ica", "ica")])
def test_features_of_every_surface_lead(spark, name, method):
    rows = ch.surface_leads(signals._rated(spark, TINY)).select("record_id", "label", "sample", "mv", "frequency").toPandas()
    want = {}
    for key, g in rows.groupby(["record_id", "label"]):
        x = g.sort_values("sample")["mv"].to_numpy(float)
        x = np.where(np.abs(x) <= 50, x, 0.0)
        want[key] = dsp.atrial_features(x, float(g["frequency"].iloc[0]), tuple(dsp.FEATURES), method, zlib.crc32(repr(key).encode()))
    got = {(r["record_id"], r["label"]): r for r in QUERIES[name](spark, TINY).collect()}
    assert got.keys() == want.keys() and len(got) > 3
    for key, w in want.items():
        assert all(got[key][k] == pytest.approx(v, rel=1e-6) for k, v in w.items()), key


def test_converters_give_every_reading(spark):
    assert QUERIES["digital_to_physical"](spark, TINY).count() == signals.counts(spark, TINY).count()
    assert QUERIES["physical_to_digital_clamped"](spark, TINY).filter(F.col("digital").isNotNull()).count() == signals.readings(spark, TINY).filter("mv is not null").count()


def test_entry_without_the_training_data_package(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
