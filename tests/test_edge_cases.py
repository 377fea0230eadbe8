"""Literal edge cases (expected values computed independently with pandas / NumPy)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from aerolith.functions import scalars as S
from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import stats as X
from aerolith.operators import windows as W
from aerolith.plans.features import training_frame

T0 = dt.datetime(2026, 1, 12, 0, 0)


def series(spark, values, city="K", chunk=None):
    rows = [(city, T0 + dt.timedelta(hours=i), None if v is None else float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double, i int")


def col(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_w3_w4_change_and_rolling(spark):
    out = W.change_and_rolling(series(spark, [1, None, 3, 4]))
    assert col(out, "aqi_change_rate") == [0, 0, 0, 1]
    assert col(out, "aqi_ma_3h") == [1, 1, 2, 3.5]


def test_w10_training_frame_order_of_stages(spark):
    df = series(spark, [10, 20, None, 40, 50, 60, 70, 80]).withColumn("pm2_5", F.lit(1.0)).withColumn(
        "temperature", F.lit(2.0))
    t = W.target_ahead(df, "aqi", 2)
    assert col(t, "i") == [1, 2, 3, 4, 5]
    out = training_frame(df, ahead=2, lag_offsets=[1], lag_cols={"aqi": "aqi"})
    got = [(r["i"], r["aqi"], r["aqi_target_2h"], r["aqi_lag_1h"]) for r in out.orderBy("i").collect()]
    assert got == [(4, 50.0, 70.0, 40.0), (5, 60.0, 80.0, 50.0)]


def test_w7_recent_trend(spark):
    assert W.recent_trend(series(spark, range(1, 61))).first()["recent_trend"] == pytest.approx(24.0)
    assert W.recent_trend(series(spark, range(1, 31))).first()["recent_trend"] == pytest.approx(6.0)


def test_w9_split_takes_ceiling(spark):
    out = W.chronological_split(series(spark, range(11)))
    assert col(out, "is_test") == [False] * 8 + [True] * 3


def test_halo_windows_equal_plain_windows(spark):
    vals = [float((i * 37) % 101) if i % 13 else None for i in range(200)]
    df = series(spark, vals).unionByName(series(spark, vals[::-1], city="L"))
    small = W.rolling_stats(W.lags(df, {"aqi": "aqi"}, [1, 3, 24], chunk=7), windows=(3, 6), chunk=5)
    big = W.rolling_stats(W.lags(df, {"aqi": "aqi"}, [1, 3, 24], bucket=None), windows=(3, 6), bucket=None)
    a = sorted(map(tuple, small.select(sorted(small.columns)).collect()), key=str)
    b = sorted(map(tuple, big.select(sorted(big.columns)).collect()), key=str)
    assert a == b


def test_row_index_is_consecutive_across_buckets(spark):
    df = series(spark, range(100))
    out = W.with_row_index(df, bucket="hour", total="n")
    assert col(out, "rn") == list(range(1, 101))
    assert set(col(out, "n")) == {100}


def test_j2a_j2b_upserts(spark):
    store = spark.createDataFrame([("t1", 1, 2)], "k string, a int, b int")
    batch = spark.createDataFrame([("t1", 9, 1), ("t2", 3, 1)], "k string, a int, seq int")
    ra = {r["k"]: r.asDict() for r in J.upsert_rows(store, batch, ["k"], "seq").collect()}
    assert ra["t1"]["a"] == 9 and ra["t1"]["b"] is None and ra["t2"]["a"] == 3
    rb = {r["k"]: r.asDict() for r in J.upsert_columns(store, batch, ["k"], "seq").collect()}
    assert rb["t1"] == {"k": "t1", "a": 9, "b": 2} and rb["t2"]["a"] == 3 and rb["t2"]["b"] is None
    nb = spark.createDataFrame([("t1", None, 1)], "k string, a int, seq int")
    assert J.upsert_columns(store, nb, ["k"], "seq").first().asDict() == {"k": "t1", "a": None, "b": 2}
    twice = spark.createDataFrame([("t1", 5, 1), ("t1", 6, 2)], "k string, a int, seq int")
    out = J.upsert_columns(store, twice, ["k"], "seq").collect()
    assert len(out) == 1 and out[0]["a"] == 6


VALS = [50, 50.5, 51, 300, 300.5, 501, -1]


def test_j3_and_f4_category_rules(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(VALS)], "i int, aqi double")
    j3 = col(J.category_by_range(df), "range_category")
    assert j3 == ["Good", "Hazardous", "Moderate", "Very Unhealthy", "Hazardous", "Hazardous", "Hazardous"]
    f4 = col(df.withColumn("c", S.category_by_threshold("aqi")), "c")
    assert f4 == ["Good", "Moderate", "Moderate", "Very Unhealthy", "Hazardous", "Hazardous", "Good"]


def test_j4_codes(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 6.0), (3, None)], "i int, aqi double")
    assert col(J.category_by_code(df), "aqi_category") == ["Good", "Very Poor", "Unknown", "Unknown"]


def test_f1_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 12, 8),)], "timestamp timestamp_ntz")
    r = S.calendar_parts(df, parts=["day_of_week", "quarter", "day_name"]).first()
    assert (r["day_of_week"], r["quarter"], r["day_name"]) == (0, 1, "Monday")


@pytest.mark.parametrize("aqi,t,h,w,hour,month,expected", [
    (100, 39, 80, 2, 8, 1, 183.61728),
    (100, 25, 60, 5, 23, 4, 95.0),
    (10, 10, 30, 11, 12, 7, 20.0),
    (450, 39, 80, 2, 18, 12, 500.0),
])
def test_f10_rule_forecast(spark, aqi, t, h, w, hour, month, expected):
    df = spark.createDataFrame([(float(aqi), float(t), float(h), float(w), dt.datetime(2026, month, 1, hour))],
                               "aqi double, temperature double, humidity double, wind_speed double, timestamp timestamp_ntz")
    assert df.select(S.rule_forecast().alias("p")).first()["p"] == pytest.approx(expected)


def test_f8_clip_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(S.clip("x").alias("c")).first()["c"] is None


DATA = [1, 2, 2, 3, 9, 4, 7, 50]


def frame(spark, vals=DATA):
    return spark.createDataFrame([("K", T0 + dt.timedelta(hours=i), float(v), i) for i, v in enumerate(vals)],
                                 "city string, timestamp timestamp_ntz, aqi double, i int")


def test_a5_moments(spark):
    r = A.city_moments(frame(spark), ["aqi"]).first()
    assert r["aqi_skew"] == pytest.approx(2.6798067310)
    assert r["aqi_kurtosis"] == pytest.approx(7.3449339620)
    assert r["aqi_std"] == pytest.approx(16.4902564736)


def test_a21_quantiles(spark):
    r = A.quantiles(frame(spark), "aqi").first()
    assert (r["q1"], r["q3"]) == (2.0, 7.5)


def test_x5_jarque_bera(spark):
    r = X.jarque_bera(frame(spark), ["aqi"]).first()
    assert r["jb"] == pytest.approx(8.8268260684) and r["p_value"] == pytest.approx(0.0121137630)


def test_x6_dickey_fuller(spark):
    r = X.dickey_fuller(frame(spark), "aqi").first()
    assert r["slope"] == pytest.approx(1.7884615385) and r["t_stat"] == pytest.approx(0.7675368101)
    assert r["is_stationary"] is False


def test_x1_iqr_bounds(spark):
    r = X.iqr_outliers(frame(spark, [1, 2, 3, 4, 100]), ["aqi"]).first()
    assert (r["lower"], r["upper"], r["outliers"], r["outlier_percent"]) == (-1.0, 7.0, 1, 20.0)


def test_x7_decomposition(spark):
    s = spark.createDataFrame([("K", i, float(v)) for i, v in enumerate([1, 5, 3, 4, 6, 2, 3])],
                              "city string, date int, y double")
    out = X.seasonal_decompose(s, "y", period=3).orderBy("date").collect()
    trend = [r["trend"] for r in out]
    assert trend[0] is None and trend[-1] is None
    assert trend[1:6] == pytest.approx([3, 4, 13 / 3, 4, 11 / 3])
    assert [r["seasonal"] for r in out][:3] == pytest.approx([-4 / 9, 17 / 9, -13 / 9])
    assert [r["residual"] for r in out][1:6] == pytest.approx([1 / 9, 4 / 9, 1 / 9, 1 / 9, -2 / 9])


def test_a22_constant_column_is_null(spark):
    df = frame(spark).withColumn("c", F.lit(3.0))
    r = X.corr_matrix(df, ["aqi", "c"]).first()
    assert r["correlation"] is None


def test_a29_ties_go_to_first(spark):
    df = spark.createDataFrame([(3, 5.0), (7, 5.0), (1, 2.0)], "hour int, v double")
    assert A.peak_and_trough(df, "hour", "v").first()["peak_hour"] == 3


def test_a18_null_counts_false(spark):
    df = spark.createDataFrame([(40.0,), (None,), (60.0,), (50.0,)], "aqi double")
    assert A.share_where(df, F.col("aqi") <= 50).first()["share_percent"] == 50.0


def test_s5_s6_defaults(spark):
    from aerolith.sources.payloads import decode_air, decode_weather
    w = spark.createDataFrame([('{"main": {"temp": 30, "humidity": 50, "pressure": 1000}, "wind": {"speed": 2}}',)],
                              "payload string")
    r = decode_weather(w).first()
    assert (r["wind_direction"], r["visibility"], r["weather_main"]) == (0.0, 10000.0, None)
    a = spark.createDataFrame([('{"list": []}',)], "payload string")
    assert all(v is None for v in decode_air(a).first())


def test_o5_column_order(spark):
    from aerolith.operators.stats import strong_pairs
    df = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.9), (1, 2, 0.55), (1, 3, 0.2)],
                               "i int, j int, correlation double")
    assert [(r["i"], r["j"]) for r in strong_pairs(df, 0.5, 5).collect()] == [(0, 1), (0, 2), (1, 2)]


def test_m9_strict_24h(spark):
    from aerolith.operators.ml import needs_training
    runs = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0),)], "trained_at timestamp_ntz")
    as_of = F.lit(dt.datetime(2026, 1, 2, 0)).cast("timestamp_ntz")
    assert needs_training(runs, as_of).first()["needs_training"] is True


def test_row_index_multi_level_matches_plain(spark):
    from aerolith.sources.testdata import readings
    from tests.conftest import SF001
    rd = readings(spark, SF001).select("city", "timestamp")
    a = W.with_row_index(rd, bucket=("minute", "hour", "day"), total="n")
    b = W.with_row_index(rd, bucket=None, total="n")
    assert sorted(map(tuple, a.select("city", "timestamp", "rn", "n").collect())) == \
        sorted(map(tuple, b.select("city", "timestamp", "rn", "n").collect()))


def test_global_series_without_key(spark):
    df = series(spark, [1, 2, None, 4, 5])
    out = W.change_and_rolling(df.drop("city"), by=())
    assert col(out, "aqi_change_rate") == [0, 1, 0, 0, 1]
    from aerolith.operators.stats import elliptic_envelope, iqr_outliers, zscore_anomalies
    assert iqr_outliers(df, ["aqi"], by=()).count() == 1
    assert zscore_anomalies(series(spark, range(20)), ["aqi"], by=()).count() == 20
    assert elliptic_envelope(series(spark, range(20)).withColumn("b", F.col("aqi") * F.col("aqi")), ["aqi", "b"],
                             by=(), steps=1).count() == 20


def test_time_rolling_halo_chunks_agree(spark):
    from aerolith.sources.testdata import readings
    from tests.conftest import SF001
    rd = readings(spark, SF001).select("city", "timestamp", "aqi")
    a = W.time_rolling_stats(rd, "aqi", (3, 30), chunk="hour", scale=100)
    b = W.time_rolling_stats(rd, "aqi", (3, 30), chunk="day", scale=100)
    c = W.time_rolling_stats(rd, "aqi", (3, 30), chunk="day")
    key = lambda r: (r["city"], r["timestamp"])
    ra = {key(r): r for r in a.collect()}
    rb = {key(r): r for r in b.collect()}
    rc = {key(r): r for r in c.collect()}
    assert ra.keys() == rb.keys() == rc.keys()
    for k in ra:
        assert ra[k] == rb[k]
        assert ra[k]["aqi_troll_n_30h"] == rc[k]["aqi_troll_n_30h"]
        assert abs(ra[k]["aqi_troll_mean_30h"] - rc[k]["aqi_troll_mean_30h"]) < 1e-9
