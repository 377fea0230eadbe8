"""Decode nested weather and air-pollution payloads.

Payloads arrive as JSON text (one document per row).  Decoding is
``from_json`` against a declared schema, so it runs in codegen on executors;
array elements are read with ``get`` (null when out of range, no ANSI error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType())])

WEATHER_SCHEMA = T.StructType([
    T.StructField("coord", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.DoubleType()),
                                        T.StructField("pressure", T.DoubleType())])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType()), T.StructField("deg", T.DoubleType())])),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("main", T.StringType()),
                                                       T.StructField("description", T.StringType())]))),
    T.StructField("clouds", T.StructType([T.StructField("all", T.DoubleType())])),
    T.StructField("visibility", T.DoubleType()),
])

COMPONENTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]

AIR_SCHEMA = T.StructType([
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
        T.StructField("components", T.StructType([T.StructField(c, T.DoubleType()) for c in COMPONENTS])),
    ])))
])

# Defaults applied when optional payload fields are absent.
DEFAULT_WIND_DEG = 0.0
DEFAULT_VISIBILITY = 10000.0


def decode_weather(df: DataFrame, col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Weather payload -> flat reading columns."""
    p = F.from_json(F.col(col), WEATHER_SCHEMA)
    first = F.get(p["weather"], 0)
    keep_cols = [F.col(c) for c in (keep or [])]
    return df.select(
        *keep_cols,
        p["main"]["temp"].alias("temperature"),
        p["main"]["humidity"].alias("humidity"),
        p["main"]["pressure"].alias("pressure"),
        p["wind"]["speed"].alias("wind_speed"),
        F.coalesce(p["wind"]["deg"], F.lit(DEFAULT_WIND_DEG)).alias("wind_direction"),
        first["main"].alias("weather_main"),
        first["description"].alias("weather_description"),
        p["clouds"]["all"].alias("clouds"),
        F.coalesce(p["visibility"], F.lit(DEFAULT_VISIBILITY)).alias("visibility"),
    )


def decode_air(df: DataFrame, col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Air payload -> ``aqi`` (1..5 code) and eight components; empty list -> nulls."""
    first = F.get(F.from_json(F.col(col), AIR_SCHEMA)["list"], 0)
    keep_cols = [F.col(c) for c in (keep or [])]
    return df.select(*keep_cols, first["main"]["aqi"].cast("double").alias("aqi"),
                     *[first["components"][c].alias(c) for c in COMPONENTS])


def path_or_default(c: Column, default) -> Column:
    """F16: nested field access with a default for absent values."""
    return F.coalesce(c, F.lit(default))
