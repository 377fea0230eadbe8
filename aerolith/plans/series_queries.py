"""Registered series queries (W1-W12, J8, J9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions.scalars import rule_forecast, status4, trend_label
from aerolith.operators import joins as J
from aerolith.operators import windows as W
from aerolith.plans.features import ci_features, training_frame
from aerolith.plans.registry import HOURLY_CTE, READINGS_CTE, clip_sql, d, finish, i, register, rule_sql, s, ts


def _clip_rule(v):
    return f"({clip_sql(rule_sql(v))})"
from aerolith.sources.testdata import MEASURES, hourly, table

WIN = 'OVER (PARTITION BY city ORDER BY "timestamp")'
HCOLS = ["city", "timestamp"] + MEASURES + ["n_obs"]


def _hsel(extra_d=(), extra_i=(), extra_s=()):
    cols = ["city", ts('"timestamp"', '"timestamp"')]
    cols += [d(c, c) for c in MEASURES] + [i("n_obs", "n_obs")]
    cols += [d(c, c) for c in extra_d] + [i(c, c) for c in extra_i] + [s(c, c) for c in extra_s]
    return ", ".join(cols)


_LAGS = [(c, p, k) for k in W.LAG_OFFSETS for c, p in W.LAG_PREFIX.items()]


@register("w1_lags", f"""WITH {HOURLY_CTE}
SELECT {_hsel()}, {', '.join(d(f'lag({c}, {k}) {WIN}', f'{p}_lag_{k}h') for c, p, k in _LAGS)} FROM hourly""")
def q_w1(spark, sf):
    return finish(W.lags(hourly(spark, sf)))


@register("w2_target_ahead", f"""WITH {HOURLY_CTE},
t AS (SELECT *, lead(aqi, 24) {WIN} AS aqi_target_24h FROM hourly)
SELECT {_hsel(['aqi_target_24h'])} FROM t WHERE aqi_target_24h IS NOT NULL""")
def q_w2(spark, sf):
    return finish(W.target_ahead(hourly(spark, sf)))


@register("w3_w4_change_rolling", f"""WITH {HOURLY_CTE}
SELECT {_hsel()}, {d(f'coalesce(aqi - lag(aqi, 1) {WIN}, 0)', 'aqi_change_rate')},
       {d('coalesce(avg(aqi) OVER (PARTITION BY city ORDER BY "timestamp" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), aqi)', 'aqi_ma_3h')}
FROM hourly""")
def q_w34(spark, sf):
    return finish(W.change_and_rolling(hourly(spark, sf)))


def _roll_sql(n):
    fr = f'OVER (PARTITION BY city ORDER BY "timestamp" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'
    v = ["aqi"] + [f"lag(aqi, {j}) {WIN}" for j in range(1, n)]
    cnt = " + ".join(f"CAST(({x}) IS NOT NULL AS INTEGER)" for x in v)
    tot = "0.0" + "".join(f" + coalesce({x}, 0.0)" for x in v)
    mean = f"(({tot}) / CAST(nullif({cnt}, 0) AS DOUBLE))"
    ss = "0.0" + "".join(f" + coalesce(({x} - {mean}) * ({x} - {mean}), 0.0)" for x in v)
    std = f"CASE WHEN ({cnt}) > 1 THEN sqrt(({ss}) / CAST(({cnt}) - 1 AS DOUBLE)) END"
    return ", ".join([d(mean, f"aqi_roll_mean_{n}"), d(std, f"aqi_roll_std_{n}"),
                      d(f"min(aqi) {fr}", f"aqi_roll_min_{n}"), d(f"max(aqi) {fr}", f"aqi_roll_max_{n}")])


@register("w5_rolling_stats", f"""WITH {HOURLY_CTE}
SELECT {_hsel()}, {', '.join(_roll_sql(n) for n in (3, 6, 12, 24))} FROM hourly""")
def q_w5(spark, sf):
    return finish(W.rolling_stats(hourly(spark, sf)))


@register("w6_dedupe_keep_last", f"""WITH r AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS hour_ts, ts, value AS aqi, event_id,
         row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS rn FROM events)
SELECT city, {ts('hour_ts', 'hour_ts')}, {ts('ts', '"timestamp"')}, {d('aqi', 'aqi')}, {i('event_id', 'event_id')}
FROM r WHERE rn = 1""")
def q_w6(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("city"),
                                           F.date_trunc("hour", "ts").alias("hour_ts"),
                                           F.col("ts").alias("timestamp"), F.col("value").alias("aqi"), "event_id")
    return finish(W.dedupe_keep_last(ev, ["city", "hour_ts"], "event_id"))


@register("w7_recent_trend", f"""WITH {HOURLY_CTE},
r AS (SELECT city, aqi, row_number() {WIN} AS rn, count(*) OVER (PARTITION BY city) AS n FROM hourly),
t AS (SELECT city, avg(aqi) FILTER (WHERE rn > n - 24)
                 - avg(aqi) FILTER (WHERE rn > greatest(n - 48, 0) AND rn <= greatest(n - 48, 0) + 24) AS v
      FROM r GROUP BY city)
SELECT city, {d('v', 'recent_trend')},
       CASE WHEN v > 5 THEN 'upward' WHEN v < -5 THEN 'downward' WHEN v IS NOT NULL THEN 'stable' END AS trend
FROM t""")
def q_w7(spark, sf):
    t = W.recent_trend(hourly(spark, sf))
    return finish(t.withColumn("trend", trend_label("recent_trend")))


@register("w8_city_ranking", f"""WITH {READINGS_CTE},
m AS (SELECT city, avg(aqi) AS avg_aqi FROM readings GROUP BY city),
r AS (SELECT city, avg_aqi, row_number() OVER (ORDER BY avg_aqi, city) AS rank,
             count(*) OVER () AS n FROM m)
SELECT city, {d('avg_aqi', 'avg_aqi')}, {i('rank', 'rank')},
       CASE WHEN avg_aqi <= 50 THEN 'Good' WHEN avg_aqi <= 100 THEN 'Moderate' WHEN avg_aqi <= 150 THEN 'Unhealthy'
            WHEN avg_aqi IS NOT NULL THEN 'Very Unhealthy' END AS status,
       rank = 1 AS is_best, rank = n AS is_worst FROM r""")
def q_w8(spark, sf):
    from aerolith.sources.testdata import readings
    m = readings(spark, sf).groupBy("city").agg(F.avg("aqi").alias("avg_aqi"))
    # the per-city aggregate is one row per city: a global window over it is small
    w = Window.orderBy("avg_aqi", "city")
    r = (m.withColumn("rank", F.row_number().over(w))
          .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
          .withColumn("status", status4("avg_aqi"))
          .withColumn("is_best", F.col("rank") == 1).withColumn("is_worst", F.col("rank") == F.col("__n"))
          .drop("__n"))
    return finish(r)


@register("w9_chronological_split", f"""WITH {HOURLY_CTE},
r AS (SELECT city, "timestamp", row_number() {WIN} AS rn, count(*) OVER (PARTITION BY city) AS n FROM hourly)
SELECT city, {ts('"timestamp"', '"timestamp"')}, rn > n - ceil(n * 0.2) AS is_test FROM r""")
def q_w9(spark, sf):
    return finish(W.chronological_split(hourly(spark, sf).select("city", "timestamp")))


_TF_LAGS = ", ".join(f"lag({c}, {k}) {WIN} AS {p}_lag_{k}h" for c, p, k in _LAGS)
_TF_COLS = [c for c in HCOLS if c not in ("city", "timestamp", "n_obs")]


@register("w10_training_frame", f"""WITH {HOURLY_CTE},
t AS (SELECT *, lead(aqi, 24) {WIN} AS aqi_target_24h FROM hourly),
u AS (SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week, month("timestamp") AS month,
             sin(hour("timestamp") * (2 * pi() / 24)) AS hour_sin, cos(hour("timestamp") * (2 * pi() / 24)) AS hour_cos,
             {_TF_LAGS}
      FROM t WHERE aqi_target_24h IS NOT NULL)
SELECT {_hsel(['aqi_target_24h', 'hour_sin', 'hour_cos'] + [f'{p}_lag_{k}h' for c, p, k in _LAGS], ['hour', 'day_of_week', 'month'])}
FROM u WHERE {' AND '.join(f'{p}_lag_{k}h IS NOT NULL' for c, p, k in _LAGS)}""")
def q_w10(spark, sf):
    return finish(training_frame(hourly(spark, sf)))


@register("w11_ci_features", f"""WITH {HOURLY_CTE}
SELECT {_hsel(['aqi_change_rate', 'aqi_ma_3h', 'temp_humidity_interaction'],
              ['hour', 'day_of_week', 'day_of_year', 'month', 'quarter', 'year'])}
FROM (SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week, dayofyear("timestamp") AS day_of_year,
             month("timestamp") AS month, quarter("timestamp") AS quarter, year("timestamp") AS year,
             coalesce(aqi - lag(aqi, 1) {WIN}, 0) AS aqi_change_rate,
             coalesce(avg(aqi) OVER (PARTITION BY city ORDER BY "timestamp" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), aqi) AS aqi_ma_3h,
             temperature * humidity AS temp_humidity_interaction FROM hourly)""")
def q_w11(spark, sf):
    return finish(ci_features(hourly(spark, sf)))


@register("w12_future_point", f"""WITH {HOURLY_CTE},
l AS (SELECT city, max("timestamp") AS last_ts, arg_max(aqi, "timestamp") AS last_aqi,
             arg_max(({_clip_rule('a')} + {_clip_rule('b')}) / 2, "timestamp") AS ens FROM hourly GROUP BY city)
SELECT city, {ts('last_ts + INTERVAL 24 HOUR', 'forecast_ts')}, {d('last_aqi', 'last_aqi')},
       {d('round_even(ens * 10.0, 0) / 10.0', 'ensemble')} FROM l""")
def q_w12(spark, sf):
    """Forecast point: last hour + 24 h per city, paired with the ensemble of the rule forecasts
    made at that last hour."""
    from aerolith.functions.scalars import round_half_even
    h = hourly(spark, sf)
    fp = W.future_point(h)
    ens = (rule_forecast(variant="a") + rule_forecast(variant="b")) / 2
    last = h.groupBy("city").agg(F.max_by("aqi", "timestamp").alias("last_aqi"),
                                 F.max_by(ens, "timestamp").alias("ensemble"))
    return finish(fp.join(last, "city").withColumn("ensemble", round_half_even("ensemble", 1)))


@register("j8_lag_by_time", f"""WITH {HOURLY_CTE}
SELECT h.city, {ts('h."timestamp"', '"timestamp"')}, {d('h.aqi', 'aqi')}, {d('p1.aqi', 'aqi_tlag_1h')}, {d('p24.aqi', 'aqi_tlag_24h')}
FROM hourly h
LEFT JOIN hourly p1 ON p1.city = h.city AND p1."timestamp" = h."timestamp" - INTERVAL 1 HOUR
LEFT JOIN hourly p24 ON p24.city = h.city AND p24."timestamp" = h."timestamp" - INTERVAL 24 HOUR""")
def q_j8(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp", "aqi")
    return finish(J.lag_by_time(h, "aqi", [1, 24]))


@register("j9_fill_hourly_grid", f"""WITH {HOURLY_CTE},
b AS (SELECT city, min("timestamp") AS lo, max("timestamp") AS hi FROM hourly GROUP BY city),
g AS (SELECT city, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp" FROM b)
SELECT g.city, {ts('g."timestamp"', '"timestamp"')}, {d('h.aqi', 'aqi')}, {i('h.n_obs', 'n_obs')}
FROM g LEFT JOIN hourly h ON h.city = g.city AND h."timestamp" = g."timestamp\"""")
def q_j9(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp", "aqi", "n_obs")
    return finish(J.fill_hourly_grid(h))


def _troll_sql(h):
    fr = f'OVER (PARTITION BY city ORDER BY "timestamp" RANGE BETWEEN INTERVAL {h} HOURS PRECEDING AND CURRENT ROW)'
    c = "CAST(round(aqi * 100) AS BIGINT)"
    n, s1, s2 = f"count({c}) {fr}", f"sum({c}) {fr}", f"sum({c} * {c}) {fr}"
    return ", ".join([
        i(n, f"aqi_troll_n_{h}h"), d(f"min(aqi) {fr}", f"aqi_troll_min_{h}h"), d(f"max(aqi) {fr}", f"aqi_troll_max_{h}h"),
        d(f"CAST({s1} AS DOUBLE) / (CAST({n} AS DOUBLE) * 100.0)", f"aqi_troll_mean_{h}h"),
        d(f"CASE WHEN {n} > 1 THEN sqrt(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE) / 10000.0) END",
          f"aqi_troll_std_{h}h")])


@register("w5_time_rolling_stats", f"""WITH {READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, {_troll_sql(3)}, {_troll_sql(24)} FROM readings""")
def q_w5t(spark, sf):
    """Hour-based frames over the raw readings (values with two decimals: exact integer sums)."""
    from aerolith.sources.testdata import readings
    rd = readings(spark, sf).select("city", "timestamp", "aqi")
    return finish(W.time_rolling_stats(rd, "aqi", (3, 24), scale=100))
