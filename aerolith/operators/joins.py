"""Joins in substance (J1-J9): combine, upsert, category lookups, time lags, hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.util import join_null_safe
from aerolith.operators.windows import dedupe_keep_last

# --- J1 -------------------------------------------------------------------------------------------------------


def combine_weather_air(weather: DataFrame, air: DataFrame, key: Sequence[str] = ("city",),
                        ts: str = "timestamp", weather_order: str | None = None,
                        air_order: str | None = None) -> DataFrame:
    """One row per (key, hour) on each side (latest by ``*_order``), then an inner join on
    (key, hour); on equal column names the air side wins.  Keys are unique on both
    sides after the dedupe, so the join cannot fan out or skew."""
    key = list(key)

    def one_per_hour(df, order):
        d = df.withColumn("hour_ts", F.date_trunc("hour", ts))
        return dedupe_keep_last(d, key + ["hour_ts"], order or ts)
    w = one_per_hour(weather, weather_order)
    a = one_per_hour(air, air_order)
    shared = [c for c in w.columns if c in a.columns and c not in key + ["hour_ts"]]
    return w.drop(*shared).join(a, key + ["hour_ts"], "inner")


# --- J2a / J2b ----------------------------------------------------------------------------------------------


def upsert_rows(store: DataFrame, batch: DataFrame, key: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """Concat + keep last per key: a batch row replaces the stored row whole
    (stored-only columns become null); in-batch duplicates resolve by ``ordinal``.

    The winner per key is a ``max_by`` aggregate over (source, ordinal): map-side
    combined, so a key with many copies never lands whole in one task.
    """
    key = list(key)
    s = store.withColumn("__src", F.lit(0)).withColumn("__ord", F.xxhash64(*[F.col(c) for c in store.columns]))
    # without an arrival ordinal, in-batch copies of a key are told apart by a content hash:
    # deterministic under recomputation (any copy may win, as "last" is then undefined)
    b = batch.withColumn("__src", F.lit(1)).withColumn(
        "__ord", (F.col(ordinal) if ordinal else F.xxhash64(*[F.col(c) for c in batch.columns])).cast("long"))
    u = s.unionByName(b, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in key + ["__src", "__ord"]]
    if ordinal and ordinal in cols:
        cols.remove(ordinal)
    agg = u.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("__src", "__ord")).alias("__w"))
    return agg.select(*key, *[F.col(f"__w.{c}").alias(c) for c in cols])


def upsert_columns(store: DataFrame, batch: DataFrame, key: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """``$set`` semantics.  Columns present in the batch overwrite (also with
    null), other columns keep the stored value, unknown keys are inserted.  The
    batch is de-duplicated first (last by ``ordinal``), then one full outer join on
    the key; a match marker, not ``coalesce``, picks the side.  Null keys never match."""
    key = list(key)
    if ordinal:
        b = dedupe_keep_last(batch, key, ordinal).drop(ordinal)
    else:
        b = batch
    bcols = [c for c in b.columns if c not in key]
    scols = [c for c in store.columns if c not in key]
    bb = b.select(*[F.col(c).alias(f"__b_{c}") for c in key], *[F.col(c).alias(f"__bv_{c}") for c in bcols],
                  F.lit(True).alias("__hit"))
    cond = None
    for c in key:
        e = store[c] == bb[f"__b_{c}"]
        cond = e if cond is None else cond & e
    j = store.withColumn("__in_store", F.lit(True)).join(bb, cond, "full_outer")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = [F.when(hit, F.col(f"__b_{c}")).otherwise(F.col(c)).alias(c) for c in key]
    for c in scols:
        out.append((F.when(hit, F.col(f"__bv_{c}")).otherwise(F.col(c)) if c in bcols else F.col(c)).alias(c))
    out += [F.col(f"__bv_{c}").alias(c) for c in bcols if c not in scols]
    return j.select(*out)


# --- J3 / J4 / J7 -------------------------------------------------------------------------------------------

# The category scale (name, closed integer range, colour, css class, description).
CATEGORY_SCALE = [
    ("Good", 0, 50, "#00e400", "aqi-good", "Air quality is satisfactory"),
    ("Moderate", 51, 100, "#ffff00", "aqi-moderate", "Air quality is acceptable"),
    ("Unhealthy for Sensitive Groups", 101, 150, "#ff7e00", "aqi-unhealthy-sensitive",
     "Health effects for sensitive groups"),
    ("Unhealthy", 151, 200, "#ff0000", "aqi-unhealthy", "Everyone may experience health effects"),
    ("Very Unhealthy", 201, 300, "#8f3f97", "aqi-very-unhealthy", "Health alert: serious effects"),
    ("Hazardous", 301, 500, "#7e0023", "aqi-hazardous", "Emergency conditions"),
]
CATEGORY_FALLBACK = "Hazardous"


def category_scale(spark) -> DataFrame:
    """The scale as a dimension table (F17 range text included)."""
    df = spark.createDataFrame(CATEGORY_SCALE, "category string, lo int, hi int, color string, css_class string, "
                                               "description string")
    return df.withColumn("range_text", F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))


def category_by_range(df: DataFrame, col: str = "aqi", prefix: str = "range_") -> DataFrame:
    """First scale row whose closed range holds the value, else Hazardous.

    The six-row scale is a fixed literal, so the range lookup compiles to one
    CASE over the struct of attributes: no join, no broadcast, whole-stage codegen.
    Gaps between ranges (50 < x < 51, ...) and values outside 0..500 fall back.
    """
    v = F.col(col)
    fb = next(r for r in CATEGORY_SCALE if r[0] == CATEGORY_FALLBACK)

    def st(r):
        return F.struct(F.lit(r[0]).alias("category"), F.lit(r[3]).alias("color"), F.lit(r[4]).alias("css_class"),
                        F.lit(r[5]).alias("description"))
    e = None
    for r in CATEGORY_SCALE:
        cond = v.between(r[1], r[2])
        e = F.when(cond, st(r)) if e is None else e.when(cond, st(r))
    e = e.otherwise(st(fb))
    return df.withColumn("__cat", e).select(
        "*", *[F.col(f"__cat.{f}").alias(f"{prefix}{f}") for f in ("category", "color", "css_class", "description")]
    ).drop("__cat")


# Code -> name of the 1..5 air-quality index of the live feed.
CODE_NAMES = {1: "Good", 2: "Fair", 3: "Moderate", 4: "Poor", 5: "Very Poor"}


def category_by_code(df: DataFrame, col: str = "aqi", out: str = "aqi_category") -> DataFrame:
    """1..5 -> Good / Fair / Moderate / Poor / Very Poor, anything else Unknown."""
    m = F.create_map(*[x for k, v in CODE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    code = F.when(F.col(col) == F.floor(F.col(col)), F.col(col).cast("int"))
    return df.withColumn(out, F.coalesce(F.try_element_at(m, code), F.lit("Unknown")))


# Public PM2.5 (24 h, ug/m3) breakpoints -> index breakpoints (classic US scale).
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]


def pm25_to_aqi(c, out_of_range_null: bool = True) -> Column:
    """Piecewise-linear index from PM2.5 (concentration truncated to 0.1)."""
    x = F.floor(c * 10) / 10 if isinstance(c, Column) else F.floor(F.col(c) * 10) / 10
    e = None
    for clo, chi, ilo, ihi in PM25_BREAKPOINTS:
        val = (F.lit(float(ihi - ilo)) / F.lit(chi - clo)) * (x - F.lit(clo)) + F.lit(float(ilo))
        cond = x.between(clo, chi)
        e = F.when(cond, val) if e is None else e.when(cond, val)
    return e if out_of_range_null else e.otherwise(F.lit(500.0))


# --- J6 --------------------------------------------------------------------------------------------------------


def predictions_with_metrics(pred: DataFrame, metrics: DataFrame, on="model") -> DataFrame:
    """Comparison row per model: prediction joined with its metrics (models without metrics kept)."""
    return pred.join(metrics, on, "left")


# --- J8 / J9 ---------------------------------------------------------------------------------------------------


def lag_by_time(df: DataFrame, col: str, hours: Sequence[int], by: Sequence[str] = ("city",),
                ts: str = "timestamp") -> DataFrame:
    """Value exactly ``h`` hours earlier (null when that hour is absent).

    Equi self-joins on (key, ts - h); the keys are unique, so each join is a
    balanced shuffle and repeated joins keep the left side's partitioning.
    """
    by = list(by)
    out = df
    for h in hours:
        r = df.select(*by, (F.col(ts) + F.expr(f"INTERVAL {int(h)} HOURS")).alias(ts),
                      F.col(col).alias(f"{col}_tlag_{h}h"))
        out = join_null_safe(out, r, by + [ts], "left")
    return out


def fill_hourly_grid(df: DataFrame, by: Sequence[str] = ("city",), ts: str = "timestamp") -> DataFrame:
    """Complete hourly calendar per key between its first and last hour; absent hours hold nulls.

    Days are generated first and hours from each day, so no single row fans out
    into a whole multi-year calendar.
    """
    by = list(by)
    b = df.groupBy(*by).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    days = b.select(*by, "__lo", "__hi", F.explode(F.sequence(F.date_trunc("day", "__lo"), F.date_trunc("day", "__hi"),
                                                              F.expr("INTERVAL 1 DAY"))).alias("__day"))
    start = F.greatest(F.col("__day"), F.date_trunc("hour", "__lo"))
    stop = F.least(F.col("__day") + F.expr("INTERVAL 23 HOURS"), F.col("__hi"))
    grid = days.select(*by, F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 HOUR"))).alias(ts))
    return join_null_safe(grid, df, by + [ts], "left")
