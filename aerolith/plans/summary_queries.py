"""Registered aggregation queries (A1-A34) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import aggregates as A
from aerolith.plans.registry import NULL_READINGS_CTE, READINGS_CTE, category_sql, d, dt, finish, i, register, ts
from aerolith.sources.testdata import readings, readings_with_nulls

NUM7 = ["aqi", "pm2_5", "pm10", "temperature", "humidity", "no2", "o3"]


@register("a1_summary", f"""WITH {READINGS_CTE}
SELECT {d('avg(aqi)', 'mean')}, {d('stddev_samp(aqi)', 'std')}, {d('min(aqi)', 'min')}, {d('max(aqi)', 'max')},
       {i('count(aqi)', 'count')}, {d('quantile_cont(aqi, 0.5)', 'median')} FROM readings""")
def q_a1(spark, sf):
    return finish(A.summary(readings(spark, sf), "aqi"))


@register("a2_describe", f"""WITH {READINGS_CTE},
l AS (UNPIVOT (SELECT {', '.join(NUM7)} FROM readings) ON {', '.join(NUM7)} INTO NAME "column" VALUE value)
SELECT "column", {i('count(value)', 'count')}, {d('avg(value)', 'mean')}, {d('stddev_samp(value)', 'std')},
       {d('min(value)', 'min')}, {d('max(value)', 'max')}, {d('quantile_cont(value, 0.25)', 'p25')},
       {d('quantile_cont(value, 0.5)', 'p50')}, {d('quantile_cont(value, 0.75)', 'p75')}
FROM l GROUP BY "column\"""")
def q_a2(spark, sf):
    return finish(A.describe(readings(spark, sf), NUM7))


@register("a3_collection_stats", f"""WITH {READINGS_CTE}
SELECT {i('count(*)', 'total_records')}, {ts('min("timestamp")', 'earliest')}, {ts('max("timestamp")', 'latest')},
       {d('avg(aqi)', 'avg_aqi')}, {d('min(aqi)', 'min_aqi')}, {d('max(aqi)', 'max_aqi')}
FROM readings WHERE city = 'purchase'""")
def q_a3(spark, sf):
    return finish(A.collection_stats(readings(spark, sf), "purchase"))


@register("a4_city_summary5", f"""WITH {READINGS_CTE}
SELECT city, {d('avg(aqi)', 'mean')}, {d('stddev_samp(aqi)', 'std')}, {d('min(aqi)', 'min')}, {d('max(aqi)', 'max')},
       {i('count(aqi)', 'count')}, {d('quantile_cont(aqi, 0.5)', 'median')} FROM readings GROUP BY city""")
def q_a4(spark, sf):
    return finish(A.summary(readings(spark, sf), "aqi", by=["city"]))


def _moments_sql(c):
    return (f"{d(f'avg({c})', f'{c}_mean')}, {d(f'stddev_samp({c})', f'{c}_std')}, "
            f"{d(f'skewness({c})', f'{c}_skew')}, {d(f'kurtosis({c})', f'{c}_kurtosis')}")


@register("a5_city_moments", f"""WITH {READINGS_CTE}
SELECT city, {', '.join(_moments_sql(c) for c in NUM7)} FROM readings GROUP BY city""")
def q_a5(spark, sf):
    return finish(A.city_moments(readings(spark, sf), NUM7))


@register("a6_city_multi_agg", f"""WITH {READINGS_CTE}
SELECT city, {d('round_even(avg(aqi) * 100.0, 0) / 100.0', 'aqi_mean')}, {d('round_even(stddev_samp(aqi) * 100.0, 0) / 100.0', 'aqi_std')},
       {d('round_even(min(aqi) * 100.0, 0) / 100.0', 'aqi_min')}, {d('round_even(max(aqi) * 100.0, 0) / 100.0', 'aqi_max')},
       {d('round_even(avg(pm2_5) * 100.0, 0) / 100.0', 'pm2_5_mean')}, {d('round_even(stddev_samp(pm2_5) * 100.0, 0) / 100.0', 'pm2_5_std')},
       {d('round_even(avg(temperature) * 100.0, 0) / 100.0', 'temperature_mean')}, {d('round_even(avg(humidity) * 100.0, 0) / 100.0', 'humidity_mean')}
FROM readings GROUP BY city""")
def q_a6(spark, sf):
    return finish(A.city_multi_agg(readings(spark, sf)))


@register("a7_city_report", f"""WITH {READINGS_CTE}
SELECT city, {i('count(*)', 'records')}, {d('avg(aqi)', 'avg_aqi')}, {d('avg(pm2_5)', 'avg_pm25')},
       {d('avg(temperature)', 'avg_temperature')}, {d('stddev_samp(aqi)', 'aqi_std')} FROM readings GROUP BY city""")
def q_a7(spark, sf):
    return finish(A.city_report(readings(spark, sf)))


@register("a8_category_distribution", f"""WITH {READINGS_CTE},
c AS (SELECT {category_sql('aqi')} AS aqi_category, count(*) AS n FROM readings GROUP BY 1)
SELECT aqi_category, {i('n', 'count')}, {d('n * 100.0 / sum(n) OVER ()', 'percentage')} FROM c""")
def q_a8(spark, sf):
    return finish(A.category_distribution(readings(spark, sf)))


@register("a9_daily_mean", f"""WITH {READINGS_CTE}
SELECT {dt('CAST("timestamp" AS DATE)', 'date')}, {d('avg(aqi)', 'aqi_mean')} FROM readings GROUP BY CAST("timestamp" AS DATE)""")
def q_a9(spark, sf):
    return finish(A.daily_mean(readings(spark, sf)))


@register("a10_hourly_profile", f"""WITH {READINGS_CTE}
SELECT {i('hour("timestamp")', 'hour')}, {d('avg(aqi)', 'aqi_mean')}, {d('avg(pm2_5)', 'pm2_5_mean')}
FROM readings GROUP BY hour("timestamp")""")
def q_a10(spark, sf):
    return finish(A.hourly_profile(readings(spark, sf), ["aqi", "pm2_5"]))


@register("a11_weekday_profile", f"""WITH {READINGS_CTE},
days AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
                               (5, 'Saturday'), (6, 'Sunday')) t(day_index, day_name)),
a AS (SELECT isodow("timestamp") - 1 AS day_index, avg(aqi) AS aqi_mean FROM readings GROUP BY 1)
SELECT {i('days.day_index', 'day_index')}, day_name, {d('aqi_mean', 'aqi_mean')} FROM days LEFT JOIN a USING (day_index)""")
def q_a11(spark, sf):
    return finish(A.weekday_profile(readings(spark, sf)))


@register("a12_resample_mean", f"""WITH {READINGS_CTE}
SELECT city, {dt('CAST("timestamp" AS DATE)', 'date')}, {d('avg(aqi)', 'aqi_mean')} FROM readings
GROUP BY city, CAST("timestamp" AS DATE)""")
def q_a12(spark, sf):
    return finish(A.daily_mean(readings(spark, sf), by=["city"]))


_NCOLS = ["city", "timestamp", "aqi", "pm2_5", "temperature", "humidity"]


@register("a13_null_profile", f"""WITH {NULL_READINGS_CTE},
l AS (UNPIVOT (SELECT count(*) AS rws, {', '.join(f'count(*) - count("{c}") AS "{c}"' for c in _NCOLS)} FROM nreadings)
      ON {', '.join(f'"{c}"' for c in _NCOLS)} INTO NAME "column" VALUE missing_count)
SELECT "column", {i('missing_count', 'missing_count')}, {d('missing_count * 100.0 / rws', 'missing_percent')}
FROM l WHERE missing_count > 0""")
def q_a13(spark, sf):
    return finish(A.null_profile(readings_with_nulls(spark, sf).select(*_NCOLS)))


@register("a14_null_cells", f"""WITH {NULL_READINGS_CTE}
SELECT {i(' + '.join(f'count(*) - count("{c}")' for c in _NCOLS), 'null_cells')}, {i('count(*)', '"rows"')},
       {d('(' + ' + '.join(f'count(*) - count("{c}")' for c in _NCOLS) + f') * 100.0 / (count(*) * {len(_NCOLS)})', 'null_percent')}
FROM nreadings""")
def q_a14(spark, sf):
    return finish(A.null_cells(readings_with_nulls(spark, sf).select(*_NCOLS)))


@register("a15_duplicate_rows", f"""WITH {READINGS_CTE}
SELECT {i('coalesce(sum(n - 1), 0)', 'duplicate_rows')} FROM (SELECT count(*) AS n FROM readings GROUP BY city, "timestamp", aqi, pm2_5, temperature, humidity, pressure, wind_speed, pm10, co, no2, so2, o3)""")
def q_a15(spark, sf):
    return finish(A.duplicate_rows(readings(spark, sf)))


@register("a16_distinct_cities", f"""WITH {READINGS_CTE} SELECT {i('count(DISTINCT city)', 'distinct_city')} FROM readings""")
def q_a16(spark, sf):
    return finish(A.distinct_values(readings(spark, sf), "city"))


@register("a17_date_range", f"""WITH {READINGS_CTE}
SELECT city, {ts('min("timestamp")', 'start')}, {ts('max("timestamp")', '"end"')},
       strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%S') AS start_iso, strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S') AS end_iso,
       strftime(min("timestamp"), '%Y-%m-%d %H:%M') AS start_text, strftime(max("timestamp"), '%Y-%m-%d %H:%M') AS end_text
FROM readings GROUP BY city""")
def q_a17(spark, sf):
    return finish(A.date_range(readings(spark, sf), by=["city"]))


@register("a18_share_where", f"""WITH {NULL_READINGS_CTE}
SELECT city, {d('avg(CAST(coalesce(aqi <= 50, false) AS INTEGER)) * 100', 'share_percent')} FROM nreadings GROUP BY city""")
def q_a18(spark, sf):
    rd = readings_with_nulls(spark, sf)
    return finish(A.share_where(rd, F.col("aqi") <= 50, by=["city"]))


@register("a21_quantiles", f"""WITH {READINGS_CTE}
SELECT city, {d('quantile_cont(aqi, 0.25)', 'q1')}, {d('quantile_cont(aqi, 0.75)', 'q3')} FROM readings GROUP BY city""")
def q_a21(spark, sf):
    return finish(A.quantiles(readings(spark, sf), "aqi", by=["city"]))


_BOX = ["aqi", "pm2_5", "pm10", "no2"]


@register("a25_boxplot_stats", f"""WITH {READINGS_CTE},
l AS (UNPIVOT (SELECT city, {', '.join(_BOX)} FROM readings) ON {', '.join(_BOX)} INTO NAME variable VALUE value),
q AS (SELECT city, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT l.city, l.variable, {d('q1', 'q1')}, {d('median', 'median')}, {d('q3', 'q3')}, {d('min(value)', 'min')},
       {d('max(value)', 'max')},
       {d('min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)', 'whisker_low')},
       {d('max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)', 'whisker_high')},
       {i('count(*) FILTER (WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))', 'n_fliers')}
FROM l JOIN q USING (city, variable) GROUP BY l.city, l.variable, q1, median, q3""")
def q_a25(spark, sf):
    return finish(A.boxplot_stats(readings(spark, sf), _BOX))


@register("a26_histogram", f"""WITH {READINGS_CTE},
r AS (SELECT min(aqi) AS lo, max(aqi) AS hi FROM readings),
b AS (SELECT CAST(coalesce(least(29, floor((aqi - lo) / ((hi - lo) / 30.0))), 0) AS BIGINT) AS bin, lo, hi FROM readings, r)
SELECT {i('bin', 'bin')}, {i('count(*)', 'count')}, {d('lo + bin * (hi - lo) / 30', 'bin_lo')},
       {d('lo + (bin + 1) * (hi - lo) / 30', 'bin_hi')} FROM b GROUP BY bin, lo, hi""")
def q_a26(spark, sf):
    return finish(A.histogram(readings(spark, sf), "aqi", bins=30))


@register("a29_peak_and_trough", f"""WITH {READINGS_CTE},
h AS (SELECT hour("timestamp") AS hour, avg(aqi) AS m FROM readings GROUP BY 1)
SELECT {i('arg_min(hour, (-m, hour))', 'peak_hour')}, {i('arg_min(hour, (m, hour))', 'trough_hour')} FROM h""")
def q_a29(spark, sf):
    prof = A.hourly_profile(readings(spark, sf))
    return finish(A.peak_and_trough(prof, "hour", "aqi_mean"))


@register("a33_kpi_row", f"""WITH {READINGS_CTE}
SELECT city, {d('avg(aqi)', 'average')}, {d('max(aqi)', 'peak')}, {d('min(aqi)', 'minimum')},
       {d('avg(CAST(coalesce(aqi <= 50, false) AS INTEGER)) * 100', 'good_air_percent')} FROM readings GROUP BY city""")
def q_a33(spark, sf):
    return finish(A.kpi_row(readings(spark, sf), by=["city"]))


@register("a34_radar_frame", f"""WITH {READINGS_CTE},
m AS (SELECT city, round_even(avg(aqi) * 100.0, 0) / 100.0 AS aqi_mean, round_even(avg(pm2_5) * 100.0, 0) / 100.0 AS pm2_5_mean,
             round_even(avg(temperature) * 100.0, 0) / 100.0 AS temperature_mean, round_even(avg(humidity) * 100.0, 0) / 100.0 AS humidity_mean
      FROM readings GROUP BY city)
SELECT city, {d('aqi_mean', 'aqi_mean')}, {d('pm2_5_mean', 'pm2_5_mean')}, {d('temperature_mean', 'temperature_mean')},
       {d('humidity_mean', 'humidity_mean')},
       {d('greatest(max(aqi_mean) OVER (), max(pm2_5_mean) OVER (), max(temperature_mean) OVER (), max(humidity_mean) OVER ()) * 1.1', 'axis_max')}
FROM m""")
def q_a34(spark, sf):
    return finish(A.radar_frame(readings(spark, sf)))


@register("a30_freshness", f"""WITH {READINGS_CTE}
SELECT {i('recent_rows', 'recent_rows')}, {i('total_rows', 'total_rows')},
       CASE WHEN total_rows = 0 THEN 'fail' WHEN recent_rows = 0 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT count(*) FILTER (WHERE "timestamp" >= (SELECT max("timestamp") FROM readings) - INTERVAL 1 HOUR) AS recent_rows,
             count(*) AS total_rows FROM readings)""")
def q_a30(spark, sf):
    rd = readings(spark, sf)
    as_of = rd.agg(F.max("timestamp")).scalar()
    return finish(A.freshness(rd, as_of))


@register("a31_completeness_gate", f"""WITH {NULL_READINGS_CTE},
l AS (SELECT * FROM (VALUES ('aqi'), ('temperature'), ('humidity'), ('pm2_5')) t("column"))
SELECT "column", {i('rws', '"rows"')}, {i('nn', 'non_null')}, {i('bad', 'out_of_range')},
       {d('nn * 1.0 / rws', 'completeness')}, CASE WHEN nn * 1.0 / rws < 0.95 THEN 'alert' ELSE 'ok' END AS status
FROM (SELECT count(*) AS rws,
        count(aqi) AS aqi_nn, count(*) FILTER (WHERE aqi < 0 OR aqi > 500) AS aqi_bad,
        count(temperature) AS t_nn, count(*) FILTER (WHERE temperature < -50 OR temperature > 60) AS t_bad,
        count(humidity) AS h_nn, count(*) FILTER (WHERE humidity < 0 OR humidity > 100) AS h_bad,
        count(pm2_5) AS p_nn, 0 AS p_bad FROM nreadings) a,
LATERAL (SELECT * FROM (VALUES ('aqi', aqi_nn, aqi_bad), ('temperature', t_nn, t_bad), ('humidity', h_nn, h_bad),
                               ('pm2_5', p_nn, p_bad)) v("column", nn, bad)) x""")
def q_a31(spark, sf):
    return finish(A.completeness_gate(readings_with_nulls(spark, sf), ["aqi", "temperature", "humidity", "pm2_5"],
                                      ranges={"aqi": (0, 500), "temperature": (-50, 60), "humidity": (0, 100)}))


@register("a29_peak_weekday_and_city", f"""WITH {READINGS_CTE},
wd AS (SELECT isodow("timestamp") - 1 AS day_index, avg(aqi) AS m FROM readings GROUP BY 1),
c AS (SELECT city, avg(aqi) AS m FROM readings GROUP BY 1)
SELECT {i('(SELECT arg_min(day_index, (-m, day_index)) FROM wd)', 'peak_day_index')},
       {i('(SELECT arg_min(day_index, (m, day_index)) FROM wd)', 'trough_day_index')},
       (SELECT arg_min(city, (-m, city)) FROM c) AS peak_city, (SELECT arg_min(city, (m, city)) FROM c) AS trough_city""")
def q_a29b(spark, sf):
    """A29 over the weekday and the city means (ties to the first key)."""
    rd = readings(spark, sf)
    wd = rd.groupBy(F.weekday("timestamp").alias("day_index")).agg(F.avg("aqi").alias("m"))
    c = rd.groupBy("city").agg(F.avg("aqi").alias("m"))
    a = A.peak_and_trough(wd, "day_index", "m")
    b = A.peak_and_trough(c, "city", "m")
    return finish(a.select(a.peak_day_index, a.trough_day_index, b.select("peak_city").scalar().alias("peak_city"),
                           b.select("trough_city").scalar().alias("trough_city")))
