"""Aggregations (A1-A21, A25-A34).  One pass per operator wherever possible;
all aggregates are algebraic (map-side combined); exact quantiles count digits of
the values (``aerolith.functions.quantiles``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.quantiles import quantile_columns
from aerolith.functions.scalars import category_by_threshold, round_half_even
from aerolith.functions.util import attach, join_null_safe, unpivot


def _with_key(df: DataFrame, by: Sequence[str]):
    """Global aggregates get a constant key so that joins stay equi-joins."""
    if by:
        return df, list(by)
    return df.withColumn("__all", F.lit(0)), ["__all"]


def summary(df: DataFrame, col: str = "aqi", by: Sequence[str] = ()) -> DataFrame:
    """A1 / A4: mean, sample std, min, max, exact median (per group when ``by``)."""
    d, keys = _with_key(df, by)
    agg = d.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                               F.min(col).alias("min"), F.max(col).alias("max"),
                               F.count(col).alias("count"))
    med = quantile_columns(d, keys, col, [0.5], ["median"])
    out = join_null_safe(agg, med, keys, "left")
    return out.drop("__all") if not by else out


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A2: count / mean / std / min / 25% / 50% / 75% / max per numeric column (exact percentiles)."""
    d, keys = _with_key(df, by)
    long = unpivot(d, keys, cols, "column", "value")
    k2 = keys + ["column"]
    agg = long.groupBy(*k2).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                F.max("value").alias("max"))
    qs = quantile_columns(long, k2, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    out = join_null_safe(agg, qs, k2, "left")
    return out.drop("__all") if not by else out


def collection_stats(df: DataFrame, city: str | None = None, ts: str = "timestamp") -> DataFrame:
    """A3: record count, first/last timestamp, avg/min/max aqi for one city (or all)."""
    d = df if city is None else df.filter(F.col("city") == F.lit(city))
    return d.agg(F.count(F.lit(1)).alias("total_records"), F.min(ts).alias("earliest"),
                 F.max(ts).alias("latest"), F.avg("aqi").alias("avg_aqi"), F.min("aqi").alias("min_aqi"),
                 F.max("aqi").alias("max_aqi"))


def _moment_cols(c: str) -> list[Column]:
    """Bias-corrected skewness (G1) and excess kurtosis (G2) from population moments."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    g2 = F.kurtosis(c)
    G1 = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    G2 = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
            G1.alias(f"{c}_skew"), G2.alias(f"{c}_kurtosis")]


def city_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """A5: per group mean / std / skewness / kurtosis (pandas' unbiased forms); null when undefined."""
    return df.groupBy(*by).agg(*[e for c in cols for e in _moment_cols(c)])


# The per-column aggregate map of the city comparison table.
CITY_MULTI_AGG = {"aqi": ["mean", "std", "min", "max"], "pm2_5": ["mean", "std"],
                  "temperature": ["mean"], "humidity": ["mean"]}
_FN = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median,
       "count": F.count, "sum": F.sum}


def city_multi_agg(df: DataFrame, spec: dict | None = None, by: Sequence[str] = ("city",),
                   digits: int | None = 2) -> DataFrame:
    """Different functions per column, flattened ``{col}_{fn}`` names, half-even rounding."""
    spec = spec or CITY_MULTI_AGG
    exprs = []
    for c, fns in spec.items():
        for fn in fns:
            e = _FN[fn](c)
            exprs.append((round_half_even(e, digits) if digits is not None else e).alias(f"{c}_{fn}"))
    return df.groupBy(*by).agg(*exprs)


def city_report(df: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """Records, average aqi / pm2.5 / temperature, aqi std per city."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.avg("aqi").alias("avg_aqi"),
                               F.avg("pm2_5").alias("avg_pm25"), F.avg("temperature").alias("avg_temperature"),
                               F.stddev_samp("aqi").alias("aqi_std"))


def category_distribution(df: DataFrame, col: str = "aqi", by: Sequence[str] = ()) -> DataFrame:
    """Rows and share (%) per AQI category, count descending."""
    d = df.withColumn("aqi_category", category_by_threshold(col))
    counts = d.groupBy(*by, "aqi_category").agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the per-category counts (six rows per group), not over the readings
    total = F.sum("count").over(Window.partitionBy(*by)) if by else F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.col("count") * 100.0 / total).orderBy(*by, F.desc("count"), "aqi_category")


def daily_mean(df: DataFrame, col: str = "aqi", by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Mean per calendar date (days without rows do not appear)."""
    return df.groupBy(*by, F.to_date(ts).alias("date")).agg(F.avg(col).alias(f"{col}_mean"))


def hourly_profile(df: DataFrame, cols: Sequence[str] = ("aqi",), by: Sequence[str] = (),
                   ts: str = "timestamp") -> DataFrame:
    """A10: mean by hour of day."""
    return df.groupBy(*by, F.hour(ts).alias("hour")).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


# Day names Monday..Sunday (pandas day_name order used for re-indexing).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_profile(df: DataFrame, col: str = "aqi", ts: str = "timestamp") -> DataFrame:
    """A11 + J5: mean by day name over the fixed Monday..Sunday domain (null where no rows)."""
    spark = df.sparkSession
    days = spark.createDataFrame([(i, n) for i, n in enumerate(WEEKDAYS)], "day_index int, day_name string")
    agg = df.groupBy(F.weekday(ts).alias("day_index")).agg(F.avg(col).alias(f"{col}_mean"))
    return F.broadcast(days).join(agg, "day_index", "left")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count and % of rows, only columns with nulls, % descending."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["__rows"], cols, "column", "missing_count")
    return (long.filter(F.col("missing_count") > 0)
                .select("column", "missing_count",
                        (F.col("missing_count") * 100.0 / F.col("__rows")).alias("missing_percent"))
                .orderBy(F.desc("missing_percent"), "column"))


def null_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total null cells and their share of all cells."""
    cols = list(cols or df.columns)
    total = sum((F.col(c).isNull().cast("long") for c in cols[1:]), F.col(cols[0]).isNull().cast("long"))
    return df.agg(F.sum(total).alias("null_cells"), F.count(F.lit(1)).alias("rows")).select(
        F.coalesce(F.col("null_cells"), F.lit(0)).alias("null_cells"), "rows",
        F.coalesce(F.try_divide(F.col("null_cells") * 100.0, F.col("rows") * len(cols)), F.lit(0.0)).alias("null_percent"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal (null-equal) to an earlier row."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def distinct_values(df: DataFrame, col: str = "city", approx: bool = False) -> DataFrame:
    """Distinct count (HyperLogLog++ when ``approx``)."""
    e = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(e.alias(f"distinct_{col}"))


def date_range(df: DataFrame, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """First / last timestamp, plus ISO and '%Y-%m-%d %H:%M' text."""
    return (df.groupBy(*by).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
              .withColumn("start_iso", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"))
              .withColumn("end_iso", F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss"))
              .withColumn("start_text", F.date_format("start", "yyyy-MM-dd HH:mm"))
              .withColumn("end_text", F.date_format("end", "yyyy-MM-dd HH:mm")))


def share_where(df: DataFrame, pred: Column, name: str = "share_percent", by: Sequence[str] = ()) -> DataFrame:
    """% of rows where ``pred`` holds; a NULL predicate counts as false."""
    return df.groupBy(*by).agg((F.avg(F.coalesce(pred, F.lit(False)).cast("double")) * 100).alias(name))


def kpi_row(df: DataFrame, col: str = "aqi", by: Sequence[str] = ()) -> DataFrame:
    """Mean, peak, minimum and good-air share in one pass."""
    return df.groupBy(*by).agg(F.avg(col).alias("average"), F.max(col).alias("peak"), F.min(col).alias("minimum"),
                               (F.avg(F.coalesce(F.col(col) <= 50, F.lit(False)).cast("double")) * 100)
                               .alias("good_air_percent"))


def radar_frame(df: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """Per-city means of four measures and the common axis maximum x 1.1."""
    cols = ["aqi", "pm2_5", "temperature", "humidity"]
    m = df.groupBy(*by).agg(*[round_half_even(F.avg(c), 2).alias(f"{c}_mean") for c in cols])
    # global window over the per-city means (one row per city)
    axis = F.greatest(*[F.max(f"{c}_mean").over(Window.partitionBy()) for c in cols]) * 1.1
    return m.withColumn("axis_max", axis)


def quantiles(df: DataFrame, col: str, probs=(0.25, 0.75), names=("q1", "q3"), by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles, linear interpolation."""
    d, keys = _with_key(df, by)
    out = quantile_columns(d, keys, col, list(probs), list(names))
    return out.drop("__all") if not by else out


def boxplot_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """Five-number summary and 1.5 IQR whiskers per group and column."""
    long = unpivot(df, by, cols, "variable", "value")
    k = list(by) + ["variable"]
    qs = quantile_columns(long, k, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    j = attach(long.filter(F.col("value").isNotNull()), qs, k)
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (j.groupBy(*k, "q1", "median", "q3")
             .agg(F.min("value").alias("min"), F.max("value").alias("max"),
                  F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                  F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                  F.count_if(~inside).alias("n_fliers")))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin over [min, max]; the top edge is inclusive."""
    d, keys = _with_key(df, by)
    rng = d.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    j = attach(d.filter(F.col(col).isNotNull()).select(*keys, col), rng, keys)
    width = F.try_divide(F.col("__hi") - F.col("__lo"), F.lit(float(bins)))
    b = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(col) - F.col("__lo"), width))), F.lit(0))
    out = (j.withColumn("bin", b.cast("long"))
            .groupBy(*keys, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_lo", F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins)
            .withColumn("bin_hi", F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins)
            .drop("__lo", "__hi"))
    return out.drop("__all") if not by else out


def peak_and_trough(agg: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Key of the largest and smallest value; ties go to the first key in key order."""
    return agg.groupBy(*by).agg(
        F.min_by(F.col(key), F.struct(-F.col(value), F.col(key))).alias(f"peak_{key}"),
        F.min_by(F.col(key), F.struct(F.col(value), F.col(key))).alias(f"trough_{key}"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ("model", "split")) -> DataFrame:
    """MAE, RMSE, R^2 per (model, split) from a long prediction table, in one pass."""
    e = F.col(label) - F.col(prediction)
    agg = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("__sse"), F.var_pop(label).alias("__vp"))
    r2 = 1 - F.try_divide(F.col("__sse"), F.col("__vp") * F.col("n"))
    return agg.withColumn("r2", r2).drop("__sse", "__vp")


def freshness(df: DataFrame, as_of: Column, ts: str = "timestamp", window_hours: int = 1) -> DataFrame:
    """Rows in the last hour, total rows, pass / warn / fail verdict."""
    recent = F.count_if(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(window_hours)} HOURS"))
    agg = df.agg(recent.alias("recent_rows"), F.count(F.lit(1)).alias("total_rows"))
    verdict = (F.when(F.col("total_rows") == 0, "fail").when(F.col("recent_rows") == 0, "warn").otherwise("pass"))
    return agg.withColumn("status", verdict)


def completeness_gate(df: DataFrame, cols: Sequence[str], threshold: float = 0.95,
                      ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Completeness ratio per column and range violations; alert below ``threshold``."""
    ranges = ranges or {}
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        exprs.append(F.count(c).alias(f"{c}__nn"))
        lo, hi = ranges.get(c, (None, None))
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        exprs.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"{c}__bad"))
    one = df.agg(*exprs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__nn").alias("non_null"),
                      F.col(f"{c}__bad").alias("out_of_range")) for c in cols]
    long = one.select("__rows", F.inline(F.array(*parts)))
    ratio = F.coalesce(F.try_divide(F.col("non_null").cast("double"), F.col("__rows").cast("double")), F.lit(0.0))
    return long.select("column", F.col("__rows").alias("rows"), "non_null", "out_of_range",
                       ratio.alias("completeness"),
                       F.when(ratio < threshold, "alert").otherwise("ok").alias("status"))


def ensemble_mean(pred_long: DataFrame, by: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Mean, min, max and count of the valid (non-null) model predictions per key."""
    return pred_long.groupBy(*by).agg(F.avg(prediction).alias("ensemble"), F.count(prediction).alias("n_models"),
                                      F.min(prediction).alias("pred_min"), F.max(prediction).alias("pred_max"))


def cluster_profile(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Per cluster size, mean and std of each feature, and share of rows."""
    exprs = [F.count(F.lit(1)).alias("size")]
    for c in cols:
        exprs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    out = df.groupBy(cluster).agg(*exprs)
    # global window over the per-cluster aggregate (k rows)
    return out.withColumn("share", F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy()))
