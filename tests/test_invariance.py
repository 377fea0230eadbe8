"""Reordered and repartitioned input gives the same output."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import stats as X
from aerolith.operators import windows as W
from aerolith.sources.testdata import hourly, readings
from tests.conftest import SF001


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("op", [
    lambda d: W.change_and_rolling(d.select("city", "timestamp", "aqi")),
    lambda d: W.lags(d.select("city", "timestamp", "aqi", "pm2_5", "temperature")),
    lambda d: A.summary(d, "aqi", by=["city"]),
    lambda d: X.corr_matrix(d, ["aqi", "pm2_5", "temperature"], by=["city"]),
    lambda d: J.upsert_rows(d.select("city", "timestamp", "aqi"), d.select("city", "timestamp", "pm2_5"),
                            ["city", "timestamp"]),
])
def test_reordered_input_same_output(spark, op):
    h = hourly(spark, SF001)
    shuffled = h.repartition(7, F.xxhash64("timestamp")).sortWithinPartitions(F.rand(5))
    assert _rows(op(h)) == _rows(op(shuffled))


def test_readings_reordered_quantiles(spark):
    rd = readings(spark, SF001)
    a = A.quantiles(rd, "aqi", by=["city"])
    b = A.quantiles(rd.repartition(5).orderBy(F.rand(3)), "aqi", by=["city"])
    assert _rows(a) == _rows(b)
