"""Stand-in readings built from the driver's ``events`` table.

Mapping (fixed, mirrored by the DuckDB oracles in ``aerolith.plans.oracles``):
city <- event_type, timestamp <- ts, aqi <- value, pm2_5 <- props.k and the
other measures from deterministic id arithmetic.  Nothing is sampled: every
event row becomes one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.payloads import PROPS_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(events: DataFrame, extra=()) -> DataFrame:
    """One reading per event; all columns are derived by native expressions (and ``extra`` kept)."""
    props = F.from_json("props", PROPS_SCHEMA)
    uid, eid = F.col("user_id"), F.col("event_id")
    pm25 = props["k"].cast("double")
    return events.select(
        *extra,
        F.col("event_type").alias("city"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("aqi"),
        pm25.alias("pm2_5"),
        (uid % 45).cast("double").alias("temperature"),
        (uid % 100).cast("double").alias("humidity"),
        (uid % 40 + 990).cast("double").alias("pressure"),
        (eid % 13).cast("double").alias("wind_speed"),
        (pm25 * 1.5 + (uid % 7).cast("double")).alias("pm10"),
        ((eid % 97).cast("double") / 10.0).alias("co"),
        ((eid * 7) % 60).cast("double").alias("no2"),
        (uid % 20).cast("double").alias("so2"),
        ((eid + uid) % 80).cast("double").alias("o3"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(table(spark, sf_dir, "events"))


MEASURES = ["aqi", "pm2_5", "temperature", "humidity", "pressure", "wind_speed",
            "pm10", "co", "no2", "so2", "o3"]


def hourly_series(rd: DataFrame) -> DataFrame:
    """Hourly mean per city: the series ``H`` the time-series operators run on.

    ``aqi`` carries two decimals; it is summed as integer hundredths and divided
    once, so the mean is bit-identical across engines.  Partial aggregation runs
    map-side, so a hot city costs one row per task before the shuffle.
    """
    cents = F.round(F.col("aqi") * 100).cast("long")
    aggs = [(F.sum(cents).cast("double") / (F.count("aqi") * 100).cast("double")).alias("aqi")]
    aggs += [F.avg(c).alias(c) for c in MEASURES if c != "aqi"]
    aggs.append(F.count(F.lit(1)).alias("n_obs"))
    return (rd.groupBy("city", F.date_trunc("hour", "timestamp").alias("timestamp"))
              .agg(*aggs))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_series(readings(spark, sf_dir))


def readings_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with deterministic NULL cells (the tables hold none): aqi where
    event_id % 17 = 0, temperature where it is 0, humidity where it is 0."""
    rd = readings_from_events(table(spark, sf_dir, "events").withColumn(
        "value", F.when(F.col("event_id") % 17 != 0, F.col("value"))))
    return rd.withColumn("temperature", F.when(F.col("temperature") != 0, F.col("temperature"))) \
             .withColumn("humidity", F.when(F.col("humidity") != 0, F.col("humidity")))
