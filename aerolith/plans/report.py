"""EDA report as one nested row, composed from the aggregate operators in few passes.

Each part is an aggregate over the whole table reduced to one value (a struct
or a list bounded by the number of categories / cities) and attached to the
overview row as a scalar subquery; S7 writes the row as one JSON document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.scalars import status4
from aerolith.operators import aggregates as A
from aerolith.sources.store import write_report


def eda_report(rd: DataFrame, ts: str = "timestamp") -> DataFrame:
    cols = rd.columns
    overview = rd.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct("city").alias("cities"),
                      F.lit(len(cols)).alias("columns"),
                      F.date_format(F.min(ts), "yyyy-MM-dd HH:mm").alias("start"),
                      F.date_format(F.max(ts), "yyyy-MM-dd HH:mm").alias("end"))
    nulls = A.null_cells(rd).select(F.struct("null_cells", "null_percent").alias("v"))
    dups = A.duplicate_rows(rd).select(F.col("duplicate_rows").alias("v"))
    summ = A.summary(rd, "aqi").select(F.struct("mean", "std", "min", "max", "median").alias("v"))
    cats = A.category_distribution(rd).agg(
        F.sort_array(F.collect_list(F.struct(F.col("aqi_category").alias("category"), "count", "percentage")))
        .alias("v"))
    city = A.city_report(rd)
    # ranking runs over the per-city aggregate (one row per city)
    ranked = (city.withColumn("rank", F.row_number().over(Window.orderBy("avg_aqi", "city")))
                  .withColumn("status", status4("avg_aqi")))
    cities = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", "city", "records", "avg_aqi", "avg_pm25",
                                                             "avg_temperature", "aqi_std", "status"))).alias("v"))
    best = ranked.agg(F.struct(F.min_by("city", "rank").alias("best_city"),
                               F.max_by("city", "rank").alias("worst_city")).alias("v"))
    peak = A.peak_and_trough(A.hourly_profile(rd), "hour", "aqi_mean").select(F.struct("*").alias("v"))
    return overview.select(
        F.struct("total_records", "cities", "columns", "start", "end").alias("overview"),
        nulls.scalar().alias("missing"), dups.scalar().alias("duplicate_rows"), summ.scalar().alias("aqi_summary"),
        cats.scalar().alias("aqi_categories"), cities.scalar().alias("city_ranking"),
        best.scalar().alias("best_worst"), peak.scalar().alias("hourly_peak"))


def write_eda_report(rd: DataFrame, path: str) -> None:
    write_report(eda_report(rd), path)
