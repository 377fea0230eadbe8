"""Declared reading schema with column comments (S13 data dictionary)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_UGM3 = "micrograms per cubic metre"

# What each column holds and in which unit (the units are those of the payloads that S5 and S6 decode).
COLUMN_COMMENTS = {
    "timestamp": "when the reading was taken, wall-clock time of the city",
    "city": "the place that the reading belongs to; key together with timestamp",
    "temperature": "air temperature, degrees Celsius",
    "humidity": "relative humidity, percent",
    "pressure": "air pressure, hectopascal",
    "wind_speed": "wind speed, metres per second",
    "wind_direction": "where the wind comes from, degrees clockwise from north",
    "visibility": "how far one can see, metres",
    "clouds": "share of the sky under cloud, percent",
    "weather_main": "weather group of the payload",
    "weather_description": "the payload's words for the weather",
    "aqi": "air quality index (0-500 scale, see aqi_category)",
    **{c: f"{c}, {_UGM3}" for c in ("co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3")},
    "hour": "hour of the timestamp, 0 to 23 (F1)",
    "day_of_week": "weekday of the timestamp, Monday is 0 (F1)",
    "month": "month of the timestamp, 1 to 12 (F1)",
    "hour_sin": "sine of the hour's angle on a 24-hour circle (F2)",
    "hour_cos": "cosine of the hour's angle on a 24-hour circle (F2)",
    "aqi_lag_1h": "aqi one row earlier in the city (W1)",
    "aqi_lag_24h": "aqi 24 rows earlier in the city (W1)",
    "pm25_lag_1h": "pm2_5 one row earlier in the city (W1)",
    "temp_lag_1h": "temperature one row earlier in the city (W1)",
    "aqi_target_24h": "aqi 24 rows later in the city, what models learn (W2)",
}

POLLUTANTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]
WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds"]
REQUIRED = ["timestamp", "temperature", "humidity", "aqi", "pm2_5"]


def _f(name: str, dtype: T.DataType) -> T.StructField:
    meta = {"comment": COLUMN_COMMENTS[name]} if name in COLUMN_COMMENTS else {}
    return T.StructField(name, dtype, True, meta)


READING_SCHEMA = T.StructType(
    [_f("timestamp", T.TimestampNTZType()), _f("city", T.StringType())]
    + [_f(c, T.DoubleType()) for c in WEATHER]
    + [_f("weather_main", T.StringType()), _f("weather_description", T.StringType()),
       _f("aqi", T.DoubleType()), _f("aqi_category", T.StringType())]
    + [_f(c, T.DoubleType()) for c in POLLUTANTS]
)


def data_dictionary(spark: SparkSession) -> DataFrame:
    """Column -> description rows, read off the schema metadata."""
    rows = [(f.name, f.metadata.get("comment")) for f in READING_SCHEMA.fields if f.metadata.get("comment")]
    extra = [(k, v) for k, v in COLUMN_COMMENTS.items() if k not in READING_SCHEMA.fieldNames()]
    return spark.createDataFrame(rows + extra, "column string, description string")


def dtypes_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The column types of a frame as rows."""
    return spark.createDataFrame([(c, t) for c, t in df.dtypes], "column string, dtype string")
