"""Registered filter, scalar, sort, set, join and source queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import scalars as S
from aerolith.operators import filters as P
from aerolith.operators import joins as J
from aerolith.operators import setops as U
from aerolith.operators import topk as O
from aerolith.plans.features import ci_features, training_frame
from aerolith.plans.registry import (HOURLY_CTE, NULL_READINGS_CTE, READINGS_CTE, category_sql, clip_sql, d, dt,
                                     finish, i, register, rule_sql, ts)
from aerolith.sources.builders import air_payloads, weather_payloads
from aerolith.sources.payloads import decode_air, decode_weather
from aerolith.sources.testdata import MEASURES, hourly, readings, readings_from_events, readings_with_nulls, table

RCOLS = ["city", "timestamp", "aqi", "pm2_5", "temperature", "humidity", "pressure", "wind_speed", "pm10", "co",
         "no2", "so2", "o3"]


def _rsel(prefix=""):
    return ", ".join(["city", ts(f'{prefix}"timestamp"', '"timestamp"')] +
                     [d(f"{prefix}{c}", c) for c in RCOLS[2:]])


# --- P ----------------------------------------------------------------------------------------------------------

_REQ = ["timestamp", "temperature", "humidity", "aqi", "pm2_5"]


@register("p1_require_columns", f"""WITH {NULL_READINGS_CTE}
SELECT {i('count(*)', '"rows"')}, {', '.join(i(f'count(*) - count("{c}")', f'{c}_nulls') for c in _REQ)},
       {i('count(*) FILTER (WHERE ' + ' OR '.join(f'"{c}" IS NULL' for c in _REQ) + ')', 'violating_rows')}
FROM nreadings""")
def q_p1(spark, sf):
    return finish(P.require_columns(readings_with_nulls(spark, sf)))


@register("p2_default_column", f"""WITH {READINGS_CTE}
SELECT '{P.DEFAULT_CITY}' AS city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')} FROM readings""")
def q_p2(spark, sf):
    rd = readings(spark, sf).select("timestamp", "aqi")
    return finish(P.default_column(rd, "city"))


@register("p3_recent", f"""WITH {READINGS_CTE}
SELECT {_rsel()} FROM readings
WHERE "timestamp" >= (SELECT max("timestamp") FROM readings) - INTERVAL 24 HOUR AND city = 'view'""")
def q_p3(spark, sf):
    rd = readings(spark, sf)
    return finish(P.recent(rd, 24, rd.agg(F.max("timestamp")).scalar(), city="view"))


@register("p4_historical", f"""WITH {READINGS_CTE}
SELECT {_rsel()} FROM readings WHERE "timestamp" >= (SELECT max("timestamp") FROM readings) - INTERVAL 7 DAY""")
def q_p4(spark, sf):
    rd = readings(spark, sf)
    return finish(P.historical(rd, 7, rd.agg(F.max("timestamp")).scalar()))


@register("p5_for_city", f"""WITH {READINGS_CTE} SELECT {_rsel()} FROM readings WHERE city = 'click'""")
def q_p5(spark, sf):
    return finish(P.for_city(readings(spark, sf), "click"))


@register("p8_drop_column", f"""WITH {READINGS_CTE} SELECT {_rsel()} FROM readings""")
def q_p8(spark, sf):
    ev = table(spark, sf, "events")
    rd = readings_from_events(ev.withColumn("_id", F.col("event_id")))
    return finish(P.drop_columns(rd.withColumn("_id", F.lit(1)), ["_id"]))


_NSEL = ", ".join(["city", ts('"timestamp"', '"timestamp"')] + [d(c, c) for c in ["aqi", "pm2_5", "temperature", "humidity"]])


@register("p9_drop_nulls", f"""WITH {NULL_READINGS_CTE}
SELECT {_NSEL} FROM nreadings WHERE aqi IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL""")
def q_p9(spark, sf):
    rd = readings_with_nulls(spark, sf).select("city", "timestamp", "aqi", "pm2_5", "temperature", "humidity")
    return finish(P.drop_nulls(rd))


@register("p10_impute_mean", f"""WITH {NULL_READINGS_CTE},
m AS (SELECT avg(aqi) AS ma, avg(temperature) AS mt, avg(humidity) AS mh FROM nreadings)
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('coalesce(aqi, ma)', 'aqi')}, {d('pm2_5', 'pm2_5')},
       {d('coalesce(temperature, mt)', 'temperature')}, {d('coalesce(humidity, mh)', 'humidity')}
FROM nreadings, m""")
def q_p10(spark, sf):
    rd = readings_with_nulls(spark, sf).select("city", "timestamp", "aqi", "pm2_5", "temperature", "humidity")
    return finish(P.impute_mean(rd, ["aqi", "temperature", "humidity"]))


@register("p11_drop_null_target", f"""WITH {NULL_READINGS_CTE} SELECT {_NSEL} FROM nreadings WHERE aqi IS NOT NULL""")
def q_p11(spark, sf):
    rd = readings_with_nulls(spark, sf).select("city", "timestamp", "aqi", "pm2_5", "temperature", "humidity")
    return finish(P.drop_null_target(rd, "aqi"))


@register("p12_iqr_outlier_filter", f"""WITH {READINGS_CTE},
q AS (SELECT city, quantile_cont(aqi, 0.25) AS q1, quantile_cont(aqi, 0.75) AS q3 FROM readings GROUP BY city)
SELECT r.city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, {d('q1', 'q1')}, {d('q3', 'q3')}
FROM readings r JOIN q USING (city) WHERE aqi < q1 - 1.5 * (q3 - q1) OR aqi > q3 + 1.5 * (q3 - q1)""")
def q_p12(spark, sf):
    return finish(P.iqr_outliers_of(readings(spark, sf).select("city", "timestamp", "aqi"), "aqi"))


@register("p14_min_rows_gate", f"""WITH {HOURLY_CTE},
k AS (SELECT city, CAST("timestamp" AS DATE) AS day FROM hourly GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT h.city, {ts('h."timestamp"', '"timestamp"')}, {d('h.aqi', 'aqi')} FROM hourly h
JOIN k ON k.city = h.city AND k.day = CAST(h."timestamp" AS DATE)""")
def q_p14(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp", "aqi").withColumn("day", F.to_date("timestamp"))
    return finish(P.min_rows_gate(h, ["city", "day"], 20, strict=False).drop("day"))


# --- F ----------------------------------------------------------------------------------------------------------


@register("f1_calendar_parts", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {i('hour("timestamp")', 'hour')}, {i('isodow("timestamp") - 1', 'day_of_week')},
       {i('dayofyear("timestamp")', 'day_of_year')}, {i('month("timestamp")', 'month')}, {i('quarter("timestamp")', 'quarter')},
       {i('year("timestamp")', 'year')}, {dt('CAST("timestamp" AS DATE)', 'date')}, dayname("timestamp") AS day_name
FROM hourly""")
def q_f1(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp")
    return finish(S.calendar_parts(h, parts=["hour", "day_of_week", "day_of_year", "month", "quarter", "year", "date",
                                             "day_name"]))


@register("f2_cyclic", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')},
       {d('sin(CAST(hour("timestamp") AS DOUBLE) * (2 * pi() / 24))', 'hour_sin')}, {d('cos(CAST(hour("timestamp") AS DOUBLE) * (2 * pi() / 24))', 'hour_cos')},
       {d('sin(CAST(month("timestamp") AS DOUBLE) * (2 * pi() / 12))', 'month_sin')}, {d('cos(CAST(month("timestamp") AS DOUBLE) * (2 * pi() / 12))', 'month_cos')},
       {d('sin(CAST(isodow("timestamp") - 1 AS DOUBLE) * (2 * pi() / 7))', 'dow_sin')}, {d('cos(CAST(isodow("timestamp") - 1 AS DOUBLE) * (2 * pi() / 7))', 'dow_cos')}
FROM hourly""")
def q_f2(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp")
    hs, hc = S.cyclic(F.hour("timestamp"), 24)
    ms, mc = S.cyclic(F.month("timestamp"), 12)
    ds, dc = S.cyclic(F.weekday("timestamp"), 7)
    return finish(h.select("city", "timestamp", hs.alias("hour_sin"), hc.alias("hour_cos"), ms.alias("month_sin"),
                           mc.alias("month_cos"), ds.alias("dow_sin"), dc.alias("dow_cos")))


@register("f3_interaction", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('temperature * humidity', 'temp_humidity_interaction')} FROM hourly""")
def q_f3(spark, sf):
    h = hourly(spark, sf)
    return finish(h.select("city", "timestamp", S.interaction("temperature", "humidity").alias("temp_humidity_interaction")))


@register("f4_category_by_threshold", f"""WITH {READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, {category_sql('aqi')} AS aqi_category FROM readings""")
def q_f4(spark, sf):
    rd = readings(spark, sf)
    return finish(rd.select("city", "timestamp", "aqi", S.category_by_threshold("aqi").alias("aqi_category")))


@register("f5_status_bands", f"""WITH {READINGS_CTE},
m AS (SELECT city, CAST("timestamp" AS DATE) AS date, avg(aqi) AS aqi_mean FROM readings GROUP BY 1, 2)
SELECT city, {dt('date', 'date')}, {d('aqi_mean', 'aqi_mean')},
       CASE WHEN aqi_mean <= 50 THEN 'Good' WHEN aqi_mean <= 100 THEN 'Moderate' WHEN aqi_mean <= 150 THEN 'Unhealthy'
            WHEN aqi_mean IS NOT NULL THEN 'Very Unhealthy' END AS status,
       CASE WHEN aqi_mean < 50 THEN 'green' WHEN aqi_mean < 100 THEN 'yellow' WHEN aqi_mean < 150 THEN 'orange'
            WHEN aqi_mean IS NOT NULL THEN 'red' END AS colour
FROM m""")
def q_f5(spark, sf):
    m = readings(spark, sf).groupBy("city", F.to_date("timestamp").alias("date")).agg(F.avg("aqi").alias("aqi_mean"))
    return finish(m.withColumn("status", S.status4("aqi_mean")).withColumn("colour", S.status4_strict("aqi_mean")))


@register("f10_rule_forecast", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d(rule_sql('a'), 'raw_forecast')}, {d(clip_sql(rule_sql('a')), 'forecast')},
       {d(f"round_even(({clip_sql(rule_sql('a'))}) * 10.0, 0) / 10.0", 'forecast_1dp')} FROM hourly""")
def q_f10(spark, sf):
    h = hourly(spark, sf)
    raw = S.rule_forecast(variant="a", clip_result=False)
    return finish(h.select("city", "timestamp", raw.alias("raw_forecast"), S.clip(raw).alias("forecast"),
                           S.round_half_even(S.clip(raw), 1).alias("forecast_1dp")))


@register("f11_rule_forecast_b", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d(clip_sql(rule_sql('b')), 'forecast')} FROM hourly""")
def q_f11(spark, sf):
    h = hourly(spark, sf)
    return finish(h.select("city", "timestamp", S.rule_forecast(variant="b").alias("forecast")))


@register("f14_iso_ts", f"""WITH {READINGS_CTE}
SELECT city, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS iso, strftime("timestamp", '%Y-%m-%d %H:%M') AS minute_text
FROM readings""")
def q_f14(spark, sf):
    rd = readings(spark, sf)
    return finish(rd.select("city", S.iso_ts("timestamp").alias("iso"), S.minute_text("timestamp").alias("minute_text")))


# --- O / U ------------------------------------------------------------------------------------------------------


@register("o1_sort_by_ts", f"""WITH {HOURLY_CTE} SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')} FROM hourly""")
def q_o1(spark, sf):
    return finish(O.sort_by_ts(hourly(spark, sf).select("city", "timestamp", "aqi")))


@register("o2_latest_n", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')} FROM hourly ORDER BY "timestamp" DESC, city LIMIT 72""")
def q_o2(spark, sf):
    return finish(O.latest_n(hourly(spark, sf).select("city", "timestamp", "aqi"), 72))


@register("o8_most_variable_city", f"""WITH {READINGS_CTE},
m AS (SELECT city, stddev_samp(aqi) AS sd FROM readings GROUP BY city)
SELECT arg_min(city, (CASE WHEN sd IS NULL THEN 1 ELSE 0 END, -sd, city)) AS best_city FROM m""")
def q_o8(spark, sf):
    m = readings(spark, sf).groupBy("city").agg(F.stddev_samp("aqi").alias("sd"))
    return finish(O.arg_best(m, "city", "sd"))


@register("u1_concat", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, {d('pm2_5', 'pm2_5')}, CAST(NULL AS BIGINT) AS n_obs FROM readings
UNION ALL
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, CAST(NULL AS DOUBLE) AS pm2_5, {i('n_obs', 'n_obs')} FROM hourly""")
def q_u1(spark, sf):
    rd = readings(spark, sf).select("city", "timestamp", "aqi", "pm2_5")
    h = hourly(spark, sf).select("city", "timestamp", "aqi", "n_obs")
    return finish(U.concat(rd, h))


@register("u2_distinct_values", "SELECT DISTINCT event_type AS city FROM events")
def q_u2(spark, sf):
    return finish(U.distinct_values(readings(spark, sf), "city"))


# --- J ----------------------------------------------------------------------------------------------------------


@register("j3_category_by_range", f"""WITH {READINGS_CTE},
scale AS (SELECT * FROM (VALUES
  ('Good', 0, 50, '#00e400'), ('Moderate', 51, 100, '#ffff00'), ('Unhealthy for Sensitive Groups', 101, 150, '#ff7e00'),
  ('Unhealthy', 151, 200, '#ff0000'), ('Very Unhealthy', 201, 300, '#8f3f97'), ('Hazardous', 301, 500, '#7e0023'))
  t(category, lo, hi, color)),
m AS (SELECT r.city, r."timestamp", r.aqi, s.category, s.color, s.lo, s.hi FROM readings r
      LEFT JOIN scale s ON r.aqi BETWEEN s.lo AND s.hi)
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, coalesce(category, 'Hazardous') AS range_category,
       coalesce(color, '#7e0023') AS range_color, coalesce(lo || '-' || hi, '301-500') AS range_text FROM m""")
def q_j3(spark, sf):
    rd = readings(spark, sf).select("city", "timestamp", "aqi")
    out = J.category_by_range(rd).drop("range_css_class", "range_description")
    scale = J.category_scale(spark).select(F.col("category").alias("range_category"), "range_text")
    return finish(out.join(F.broadcast(scale), "range_category", "left"))


@register("j4_category_by_code", f"""WITH {READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('floor(aqi / 100) + 1', 'aqi_code')},
       CASE CAST(floor(aqi / 100) + 1 AS INTEGER) WHEN 1 THEN 'Good' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Moderate'
            WHEN 4 THEN 'Poor' WHEN 5 THEN 'Very Poor' ELSE 'Unknown' END AS aqi_category FROM readings""")
def q_j4(spark, sf):
    rd = readings(spark, sf).select("city", "timestamp", (F.floor(F.col("aqi") / 100) + 1).cast("double").alias("aqi_code"))
    return finish(J.category_by_code(rd, "aqi_code"))


def _pm25_sql(x):
    t = f"(floor({x} * 10) / 10)"
    parts = [f"WHEN {t} BETWEEN {clo} AND {chi} THEN (CAST({ihi - ilo} AS DOUBLE) / {chi - clo!r}) * ({t} - {clo!r}) + {float(ilo)!r}"
             for clo, chi, ilo, ihi in J.PM25_BREAKPOINTS]
    return "CASE " + " ".join(parts) + " END"


@register("j7_pm25_to_aqi", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('pm2_5', 'pm2_5')}, {d(_pm25_sql('pm2_5'), 'aqi_from_pm25')} FROM hourly""")
def q_j7(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp", "pm2_5")
    return finish(h.withColumn("aqi_from_pm25", J.pm25_to_aqi("pm2_5")))


_ST = "o_orderkey % 10 < 7"
_BT = "o_orderkey % 10 >= 5"


def _store_batch(spark, sf):
    o = table(spark, sf, "orders")
    store = o.filter(F.col("o_orderkey") % 10 < 7).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                            "o_orderpriority")
    b = o.filter(F.col("o_orderkey") % 10 >= 5)
    first = b.select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
                     F.lit(1).alias("seq"))
    # keys ending in 9 arrive twice; the second copy (null price) must win
    again = b.filter(F.col("o_orderkey") % 10 == 9).select(
        "o_orderkey", F.lit("V").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"),
        F.lit(2).alias("seq"))
    return store, first.unionByName(again)


_BATCH_SQL = f"""store AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE {_ST}),
batch AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 'V' ELSE 'U' END AS o_orderstatus,
                 CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE {_BT})"""


@register("j2a_upsert_rows", f"""WITH {_BATCH_SQL}
SELECT {i('coalesce(b.o_orderkey, s.o_orderkey)', 'o_orderkey')},
       {i('CASE WHEN b.o_orderkey IS NULL THEN s.o_custkey END', 'o_custkey')},
       CASE WHEN b.o_orderkey IS NULL THEN s.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       {d('CASE WHEN b.o_orderkey IS NULL THEN s.o_totalprice ELSE b.o_totalprice END', 'o_totalprice')},
       CASE WHEN b.o_orderkey IS NULL THEN s.o_orderpriority END AS o_orderpriority
FROM store s FULL OUTER JOIN batch b ON s.o_orderkey = b.o_orderkey""")
def q_j2a(spark, sf):
    store, batch = _store_batch(spark, sf)
    return finish(J.upsert_rows(store, batch, ["o_orderkey"], ordinal="seq"))


@register("j2b_upsert_columns", f"""WITH {_BATCH_SQL}
SELECT {i('coalesce(b.o_orderkey, s.o_orderkey)', 'o_orderkey')}, {i('s.o_custkey', 'o_custkey')},
       CASE WHEN b.o_orderkey IS NULL THEN s.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       {d('CASE WHEN b.o_orderkey IS NULL THEN s.o_totalprice ELSE b.o_totalprice END', 'o_totalprice')},
       s.o_orderpriority AS o_orderpriority
FROM store s FULL OUTER JOIN batch b ON s.o_orderkey = b.o_orderkey""")
def q_j2b(spark, sf):
    store, batch = _store_batch(spark, sf)
    return finish(J.upsert_columns(store, batch, ["o_orderkey"], ordinal="seq"))


# --- S ----------------------------------------------------------------------------------------------------------


@register("s1_read_readings", f"""WITH {READINGS_CTE} SELECT {_rsel()} FROM readings""")
def q_s1(spark, sf):
    return finish(readings(spark, sf))


@register("s3_scan_collection", f"""WITH {READINGS_CTE}
SELECT {_rsel()} FROM readings WHERE city = 'signup' AND aqi > 100 ORDER BY "timestamp\"""")
def q_s3(spark, sf):
    rd = readings(spark, sf)
    return finish(rd.filter((F.col("city") == "signup") & (F.col("aqi") > 100)).orderBy("timestamp"))


@register("s4_delete_where", f"""WITH {NULL_READINGS_CTE}
SELECT {_NSEL} FROM nreadings WHERE NOT coalesce(city = 'error' AND aqi > 250, false)""")
def q_s4(spark, sf):
    from aerolith.sources.store import delete_where
    rd = readings_with_nulls(spark, sf).select("city", "timestamp", "aqi", "pm2_5", "temperature", "humidity")
    return finish(delete_where(rd, (F.col("city") == "error") & (F.col("aqi") > 250)))


_W_SQL = f"""SELECT event_type AS city, {ts('ts', '"timestamp"')},
  {d('user_id % 45', 'temperature')}, {d('user_id % 100', 'humidity')}, {d('user_id % 40 + 990', 'pressure')},
  {d('event_id % 13', 'wind_speed')}, {d('CASE WHEN event_id % 3 <> 0 THEN (event_id * 7) % 360 ELSE 0 END', 'wind_direction')},
  event_type AS weather_main, event_type || ' sky' AS weather_description, {d('user_id % 100', 'clouds')},
  {d('CASE WHEN event_id % 4 <> 0 THEN (event_id % 50) * 200 ELSE 10000 END', 'visibility')} FROM events"""


@register("s5_decode_weather", _W_SQL)
def q_s5(spark, sf):
    return finish(decode_weather(weather_payloads(table(spark, sf, "events")), keep=["city", "timestamp"]))


_A_SQL = f"""SELECT event_type AS city, {ts('ts', '"timestamp"')},
  {d('CASE WHEN event_id % 11 <> 0 THEN floor(value / 100) + 1 END', 'aqi')},
  {d('CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 97 AS DOUBLE) / 10.0 END', 'co')},
  {d('CASE WHEN event_id % 11 <> 0 THEN user_id % 9 END', '"no"')},
  {d('CASE WHEN event_id % 11 <> 0 THEN (event_id * 7) % 60 END', 'no2')},
  {d('CASE WHEN event_id % 11 <> 0 THEN (event_id + user_id) % 80 END', 'o3')},
  {d('CASE WHEN event_id % 11 <> 0 THEN user_id % 20 END', 'so2')},
  {d("CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END", 'pm2_5')},
  {d("CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.5 END", 'pm10')},
  {d('CASE WHEN event_id % 11 <> 0 THEN user_id % 5 END', 'nh3')} FROM events"""


@register("s6_decode_air", _A_SQL)
def q_s6(spark, sf):
    return finish(decode_air(air_payloads(table(spark, sf, "events")), keep=["city", "timestamp"]))


@register("j1_combine_weather_air", f"""WITH w AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS hour_ts, arg_max(event_id, ts) AS w_id FROM events GROUP BY 1, 2),
a AS (SELECT event_type AS city, date_trunc('hour', ts) AS hour_ts, arg_max(event_id, event_id) AS a_id FROM events GROUP BY 1, 2),
ev AS (SELECT * FROM events)
SELECT w.city, {ts('w.hour_ts', 'hour_ts')}, {ts('ea.ts', '"timestamp"')}, {d('ew.user_id % 45', 'temperature')},
       {d('ew.user_id % 100', 'humidity')}, {d('CASE WHEN ea.event_id % 11 <> 0 THEN floor(ea.value / 100) + 1 END', 'aqi')},
       {d("CASE WHEN ea.event_id % 11 <> 0 THEN CAST(json_extract_string(ea.props, '$.k') AS DOUBLE) END", 'pm2_5')}
FROM w JOIN a ON a.city = w.city AND a.hour_ts = w.hour_ts
JOIN ev ew ON ew.event_id = w.w_id JOIN ev ea ON ea.event_id = a.a_id""")
def q_j1(spark, sf):
    ev = table(spark, sf, "events")
    w = decode_weather(weather_payloads(ev), keep=["city", "timestamp", "event_id"]).select(
        "city", "timestamp", "event_id", "temperature", "humidity")
    a = decode_air(air_payloads(ev), keep=["city", "timestamp", "event_id"]).select(
        "city", "timestamp", "event_id", "aqi", "pm2_5")
    out = J.combine_weather_air(w, a, weather_order="timestamp", air_order="event_id")
    return finish(out.drop("event_id"))


# --- S11 / S12 / P6 / P7 ------------------------------------------------------------------------------------------

_MD = ["city", "timestamp", "aqi", "pm2_5", "temperature", "humidity"]


@register("s11_store_metadata", f"""WITH {NULL_READINGS_CTE}
SELECT {i('count(*)', 'total_records')}, '{",".join(_MD)}' AS features,
       {', '.join(i(f'count(*) - count("{c}")', f'missing_{c}') for c in _MD)},
       strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S') AS "end"
FROM nreadings""")
def q_s11(spark, sf):
    from aerolith.sources.store import store_metadata
    m = store_metadata(readings_with_nulls(spark, sf).select(*_MD))
    return finish(m.select("total_records", F.array_join("features", ",").alias("features"),
                           *[F.col(f"missing_values.{c}").alias(f"missing_{c}") for c in _MD], "start", "end"))


@register("s12_sample_plot_frame")
def q_s12(spark, sf):
    from aerolith.sources.store import sample_plot_frame
    return finish(sample_plot_frame(readings(spark, sf), ["city", "timestamp", "aqi", "pm2_5"], ["city", "timestamp"],
                                    buckets=20, keep=1))


_TFC = ["city", "timestamp"]


def _p6_sql():
    from aerolith.plans.registry import ORACLES
    from aerolith.plans.series_queries import HCOLS, _LAGS
    cols = [c for c in HCOLS if c not in ("city", "timestamp")] + ["hour", "day_of_week", "month", "hour_sin", "hour_cos"]
    cols += [f"{p}_lag_{k}h" for c, p, k in _LAGS]
    sel = ", ".join(["city", '"timestamp"'] + [f'"{c}"' for c in cols])
    return f"SELECT {sel} FROM ({ORACLES['w10_training_frame']})"


@register("p6_select_features_except", _p6_sql())
def q_p6(spark, sf):
    tf = training_frame(hourly(spark, sf))
    return finish(tf.select(*_TFC, *P.select_features_except(tf)))


@register("p7_select_features_allow", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('temperature', 'temperature')}, {d('humidity', 'humidity')},
       {d('pressure', 'pressure')}, {d('wind_speed', 'wind_speed')}, {d('co', 'co')}, {d('no2', 'no2')}, {d('o3', 'o3')},
       {d('so2', 'so2')}, {d('pm2_5', 'pm2_5')}, {d('pm10', 'pm10')}, {i('hour("timestamp")', 'hour')},
       {i('isodow("timestamp") - 1', 'day_of_week')}, {i('dayofyear("timestamp")', 'day_of_year')},
       {i('month("timestamp")', 'month')}, {i('quarter("timestamp")', 'quarter')}, {i('year("timestamp")', 'year')},
       {d('coalesce(aqi - lag(aqi, 1) OVER (PARTITION BY city ORDER BY "timestamp"), 0)', 'aqi_change_rate')},
       {d('coalesce(avg(aqi) OVER (PARTITION BY city ORDER BY "timestamp" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), aqi)', 'aqi_ma_3h')},
       {d('temperature * humidity', 'temp_humidity_interaction')} FROM hourly""")
def q_p7(spark, sf):
    f = ci_features(hourly(spark, sf))
    return finish(f.select(*_TFC, *P.select_features_allow(f)))


@register("f9_round", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('round_even(aqi * 10.0, 0) / 10.0', 'aqi_half_even')},
       {d('round(aqi * 10.0) / 10.0', 'aqi_half_up')}, {d('round(aqi * 1000.0) / 1000.0', 'aqi_3dp')} FROM hourly""")
def q_f9(spark, sf):
    h = hourly(spark, sf)
    return finish(h.select("city", "timestamp", S.round_half_even("aqi", 1).alias("aqi_half_even"),
                           S.round_half_up("aqi", 1).alias("aqi_half_up"), S.round_half_up("aqi", 3).alias("aqi_3dp")))


@register("j5_reindex_weekdays", f"""WITH {READINGS_CTE},
days AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
                               (5, 'Saturday'), (6, 'Sunday')) t(day_index, day_name)),
weeks AS (SELECT DISTINCT city, date_trunc('week', "timestamp") AS week FROM readings),
a AS (SELECT city, date_trunc('week', "timestamp") AS week, isodow("timestamp") - 1 AS day_index, avg(aqi) AS aqi_mean
      FROM readings GROUP BY 1, 2, 3)
SELECT weeks.city, {ts('weeks.week', 'week')}, {i('days.day_index', 'day_index')}, day_name, {d('aqi_mean', 'aqi_mean')}
FROM weeks CROSS JOIN days LEFT JOIN a ON a.city = weeks.city AND a.week = weeks.week AND a.day_index = days.day_index""")
def q_j5(spark, sf):
    """Weekday means per (city, calendar week) re-indexed onto the fixed Monday..Sunday domain:
    the partial first / last weeks get null rows for their missing days."""
    from aerolith.operators.aggregates import WEEKDAYS
    rd = readings(spark, sf).withColumn("week", F.date_trunc("week", "timestamp"))
    agg = rd.groupBy("city", "week", F.weekday("timestamp").alias("day_index")).agg(F.avg("aqi").alias("aqi_mean"))
    days = F.inline(F.array(*[F.struct(F.lit(k).alias("day_index"), F.lit(n).alias("day_name"))
                              for k, n in enumerate(WEEKDAYS)]))
    grid = rd.select("city", "week").distinct().select("city", "week", days)
    return finish(grid.join(agg, ["city", "week", "day_index"], "left"))


@register("s2_write_readings", f"""WITH {READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {', '.join(d(c, c) for c in MEASURES)} FROM readings""")
def q_s2(spark, sf):
    """Write the readings partitioned by (city, date) twice (idempotent), read them back."""
    import uuid
    from aerolith.session import scratch_path
    from aerolith.sources.store import read_readings, write_readings
    path = scratch_path(spark, f"s2-{uuid.uuid4().hex[:12]}")
    rd = readings(spark, sf)
    write_readings(rd, path)
    write_readings(rd, path)
    return finish(read_readings(spark, path).drop("date"))


@register("s7_write_report")
def q_s7(spark, sf):
    """Write the EDA report document and read it back."""
    import uuid
    from aerolith.plans.report import write_eda_report
    from aerolith.session import scratch_path
    path = scratch_path(spark, f"s7-{uuid.uuid4().hex[:12]}")
    write_eda_report(readings(spark, sf), path)
    return spark.read.json(path)
