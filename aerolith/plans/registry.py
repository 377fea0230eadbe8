"""Registry of the named queries the driver runs, with their DuckDB oracles.

Registered queries read the driver's tables (through the stand-in mapping in
``aerolith.sources.testdata``) and return their whole result.  ``finish``
and the ``sql_*`` helpers put both sides in one presentation: integers as
BIGINT, doubles rounded to 6 places, timestamps as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
SCALE = float(10 ** DIGITS)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Uniform output types: BIGINT integers, doubles rounded, timestamps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # scale, round half away from zero on the binary value, scale back:
            # the same IEEE steps as the SQL side, so ties round alike
            c = F.round(c.cast("double") * SCALE, 0) / SCALE
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- SQL side ------------------------------------------------------------------------------------------------

def d(expr: str, name: str) -> str:
    """Double column, rounded like ``finish`` (``+ 0.0`` turns -0.0 into 0.0)."""
    return f"round(CAST({expr} AS DOUBLE) * {SCALE!r}) / {SCALE!r} + 0.0 AS {name}"


def i(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def ts(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def dt(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def s(expr: str, name: str) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name}"


# Stand-in readings and hourly series; same expressions as aerolith.sources.testdata.
READINGS_CTE = """readings AS (
  SELECT event_type AS city, ts AS "timestamp", value AS aqi,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pm2_5,
         CAST(user_id % 45 AS DOUBLE) AS temperature,
         CAST(user_id % 100 AS DOUBLE) AS humidity,
         CAST(user_id % 40 + 990 AS DOUBLE) AS pressure,
         CAST(event_id % 13 AS DOUBLE) AS wind_speed,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.5 + CAST(user_id % 7 AS DOUBLE) AS pm10,
         CAST(event_id % 97 AS DOUBLE) / 10.0 AS co,
         CAST((event_id * 7) % 60 AS DOUBLE) AS no2,
         CAST(user_id % 20 AS DOUBLE) AS so2,
         CAST((event_id + user_id) % 80 AS DOUBLE) AS o3
  FROM events)"""

HOURLY_CTE = READINGS_CTE + """,
hourly AS (
  SELECT city, date_trunc('hour', "timestamp") AS "timestamp",
         CAST(sum(CAST(round(aqi * 100) AS BIGINT)) AS DOUBLE) / CAST(count(aqi) * 100 AS DOUBLE) AS aqi,
         avg(pm2_5) AS pm2_5, avg(temperature) AS temperature, avg(humidity) AS humidity,
         avg(pressure) AS pressure, avg(wind_speed) AS wind_speed, avg(pm10) AS pm10, avg(co) AS co,
         avg(no2) AS no2, avg(so2) AS so2, avg(o3) AS o3, count(*) AS n_obs
  FROM readings GROUP BY 1, 2)"""

CATEGORY_SQL = """CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate'
  WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy'
  WHEN {x} <= 300 THEN 'Very Unhealthy' WHEN {x} IS NOT NULL THEN 'Hazardous' END"""


def category_sql(x: str) -> str:
    return CATEGORY_SQL.format(x=x)

NULL_READINGS_CTE = READINGS_CTE.replace("value AS aqi", "CASE WHEN event_id % 17 <> 0 THEN value END AS aqi") \
    .replace("CAST(user_id % 45 AS DOUBLE) AS temperature", "CAST(nullif(user_id % 45, 0) AS DOUBLE) AS temperature") \
    .replace("CAST(user_id % 100 AS DOUBLE) AS humidity", "CAST(nullif(user_id % 100, 0) AS DOUBLE) AS humidity") \
    .replace("readings AS (", "nreadings AS (", 1)


# Rule forecast (F10 / F11) in SQL, same factor table as aerolith.functions.scalars.
_RULE_A = """(coalesce({a}, 50.0)
  * CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 THEN {rush} ELSE {off} END
  * CASE WHEN coalesce({h}, 60.0) > {hh} THEN {hhf} WHEN coalesce({h}, 60.0) < {hl} THEN {hlf} ELSE 1.0 END
  * CASE WHEN coalesce({w}, 5.0) < {wl} THEN {wlf} WHEN coalesce({w}, 5.0) > {wh} THEN {whf} ELSE 1.0 END
  * CASE WHEN coalesce({t}, 25.0) > {th} THEN {thf} WHEN coalesce({t}, 25.0) < {tl} THEN {tlf} ELSE 1.0 END
  * CASE WHEN month(ts) IN (12, 1, 2) THEN {win} WHEN month(ts) IN (6, 7, 8) THEN {mon} ELSE 1.0 END)"""


def rule_sql(variant="a", a="aqi", t="temperature", h="humidity", w="wind_speed", tcol='"timestamp"'):
    from aerolith.functions.scalars import RULE_FACTORS
    f = RULE_FACTORS[variant]
    return _RULE_A.format(a=a, t=t, h=h, w=w, rush=f["rush"], off=f["offpeak"], hh=f["hum_hi"][0], hhf=f["hum_hi"][1],
                          hl=f["hum_lo"][0], hlf=f["hum_lo"][1], wl=f["wind_lo"][0], wlf=f["wind_lo"][1],
                          wh=f["wind_hi"][0], whf=f["wind_hi"][1], th=f["temp_hi"][0], thf=f["temp_hi"][1],
                          tl=f["temp_lo"][0], tlf=f["temp_lo"][1], win=f["winter"], mon=f["monsoon"]
                          ).replace("(ts)", f"({tcol})")


def clip_sql(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(20.0, least(500.0, {x})) END"
