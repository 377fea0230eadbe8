"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.quantiles import quantile_columns
from aerolith.functions.util import attach, numeric_columns
from aerolith.sources.schema import REQUIRED


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str] = REQUIRED) -> DataFrame:
    """Fail when a required column is absent; return per-column null (violation) counts."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing required columns: {missing}")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols],
                  F.count_if(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) > 0).alias("violating_rows"))


# The city written into readings that arrive without a city column.
DEFAULT_CITY = "Karachi"


def default_column(df: DataFrame, col: str = "city", value=DEFAULT_CITY) -> DataFrame:
    """Add a constant column only when it is absent."""
    return df if col in df.columns else df.withColumn(col, F.lit(value))


def _since(ts: str, as_of: Column, interval: str) -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {interval}")


def recent(df: DataFrame, hours: int, as_of: Column, city: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (optionally one city), newest first."""
    d = df.filter(_since(ts, as_of, f"{int(hours)} HOURS"))
    if city is not None:
        d = d.filter(F.col("city") == city)
    return d.orderBy(F.col(ts).desc(), *[c for c in ("city",) if c in df.columns])


def historical(df: DataFrame, days: int, as_of: Column, city: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, oldest first."""
    d = df.filter(_since(ts, as_of, f"{int(days)} DAYS"))
    if city is not None:
        d = d.filter(F.col("city") == city)
    return d.orderBy(F.col(ts).asc(), *[c for c in ("city",) if c in df.columns])


def for_city(df: DataFrame, city: str) -> DataFrame:
    """P5: equality filter; prunes partitions when the table is partitioned by city."""
    return df.filter(F.col("city") == F.lit(city))


def select_features_except(df: DataFrame, target: str = "aqi_target_24h",
                           drop: Sequence[str] = ("timestamp", "city", "aqi_category")) -> list[str]:
    """Numeric columns other than keys, category, target and any ``aqi_target_*``."""
    return [c for c in numeric_columns(df) if c not in drop and c != target and not c.startswith("aqi_target_")]


# The allow-list of model features of the scheduled training job.
FEATURE_ALLOW_LIST = [
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds",
    "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3",
    "hour", "day_of_week", "day_of_year", "month", "quarter", "year",
    "aqi_change_rate", "aqi_ma_3h", "temp_humidity_interaction",
]


def select_features_allow(df: DataFrame, allow: Sequence[str] = FEATURE_ALLOW_LIST) -> list[str]:
    """Allow-list intersected with the frame; fails when nothing is left."""
    got = [c for c in allow if c in df.columns]
    if not got:
        raise MissingColumnsError("none of the allowed feature columns is present")
    return got


def drop_columns(df: DataFrame, cols: Sequence[str] = ("_id",)) -> DataFrame:
    """Strip storage keys."""
    return df.drop(*cols)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``subset`` (any column when None)."""
    return df.na.drop(subset=list(subset) if subset else None)


def impute_mean(df: DataFrame, cols: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """P10: fill nulls with the column mean (of ``stats_from``, e.g. the training rows).

    The means are one aggregate row, attached through a scalar subquery.
    """
    src = stats_from if stats_from is not None else df
    means = src.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Keep rows whose target is present."""
    return df.filter(F.col(target).isNotNull())


def iqr_outliers_of(df: DataFrame, col: str, by: Sequence[str] = ("city",), k: float = 1.5, keep_outliers: bool = True) -> DataFrame:
    """Rows outside (or, without ``keep_outliers``, inside) Q1 - k IQR and Q3 + k IQR of their group, with
    ``q1`` and ``q3``.  A null value is neither; a null key is a group of its own."""
    if not by:
        return iqr_outliers_of(df.withColumn("__all", F.lit(0)), col, ["__all"], k, keep_outliers).drop("__all")
    fences = quantile_columns(df, list(by), col, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col(col) < F.col("q1") - k * iqr) | (F.col(col) > F.col("q3") + k * iqr)
    return attach(df, fences, list(by)).filter(outside if keep_outliers else ~outside)


def min_rows_gate(df: DataFrame, by: Sequence[str], n: int, strict: bool = True) -> DataFrame:
    """Keep only groups with more than (or at least) ``n`` rows (count per group, semi join)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    keep = counts.filter(F.col("__n") > n if strict else F.col("__n") >= n).drop("__n")
    return attach(df, keep, list(by), "left_semi")
