"""Flagship: readings -> hourly series -> category -> lags / change / rolling -> city x category profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.scalars import calendar_parts, category_by_threshold
from aerolith.operators.windows import DEFAULT_CHUNK, series_shift
from aerolith.plans.registry import HOURLY_CTE, category_sql, d, finish, i, register
from aerolith.sources.testdata import hourly


def flagship_frame(h: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    h = calendar_parts(h.withColumn("aqi_category", category_by_threshold("aqi")), parts=["hour"])

    def compute(w):
        return {
            "aqi_lag_1h": F.lag("aqi", 1).over(w),
            "aqi_lag_24h": F.lag("aqi", 24).over(w),
            "aqi_change_rate": F.coalesce(F.col("aqi") - F.lag("aqi", 1).over(w), F.lit(0.0)),
            "aqi_ma_3h": F.coalesce(F.avg("aqi").over(w.rowsBetween(-2, 0)), F.col("aqi")),
        }
    feats = series_shift(h, ("city",), "timestamp", compute, back=24, chunk=chunk)
    return (feats.groupBy("city", "aqi_category")
                 .agg(F.count(F.lit(1)).alias("n_hours"),
                      F.avg("aqi").alias("mean_aqi"),
                      F.avg("aqi_change_rate").alias("mean_change_rate"),
                      F.avg("aqi_ma_3h").alias("mean_ma_3h"),
                      F.count("aqi_lag_24h").alias("n_with_lag_24h"),
                      F.avg("aqi_lag_1h").alias("mean_lag_1h"),
                      F.avg("hour").alias("mean_hour")))


FLAGSHIP_SQL = f"""WITH {HOURLY_CTE},
f AS (
  SELECT city, {category_sql('aqi')} AS aqi_category, aqi, hour("timestamp") AS hour,
         lag(aqi, 1) OVER (PARTITION BY city ORDER BY "timestamp") AS aqi_lag_1h,
         lag(aqi, 24) OVER (PARTITION BY city ORDER BY "timestamp") AS aqi_lag_24h,
         coalesce(aqi - lag(aqi, 1) OVER (PARTITION BY city ORDER BY "timestamp"), 0) AS aqi_change_rate,
         coalesce(avg(aqi) OVER (PARTITION BY city ORDER BY "timestamp"
                                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), aqi) AS aqi_ma_3h
  FROM hourly)
SELECT city, aqi_category, {i('count(*)', 'n_hours')}, {d('avg(aqi)', 'mean_aqi')},
       {d('avg(aqi_change_rate)', 'mean_change_rate')}, {d('avg(aqi_ma_3h)', 'mean_ma_3h')},
       {i('count(aqi_lag_24h)', 'n_with_lag_24h')}, {d('avg(aqi_lag_1h)', 'mean_lag_1h')},
       {d('avg(hour)', 'mean_hour')}
FROM f GROUP BY city, aqi_category"""


@register("flagship_city_category_profile", FLAGSHIP_SQL)
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(flagship_frame(hourly(spark, sf_dir)))
