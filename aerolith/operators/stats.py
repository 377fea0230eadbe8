"""Correlation family and statistical tests.

All are aggregates (map-side combined) over the whole table, joined back to
rows only through per-group statistic tables (one row per group)."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, erfc, exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.quantiles import quantile_columns
from aerolith.functions.scalars import corr_direction, corr_strength
from aerolith.functions.util import attach, join_null_safe, unpivot
from aerolith.operators.windows import with_row_index
from aerolith.session import ensure_checkpoint_dir


def _pair_exprs(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.covar_samp(xs, ys), F.stddev_samp(xs), F.stddev_samp(ys), F.count(xs)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) when a side is constant."""
    cov, sx, sy, _ = _pair_exprs(x, y)
    return F.try_divide(cov, sx * sy)


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Every pair (i < j) in one aggregation pass; long result
    ``by..., i, j, feature1, feature2, correlation, n``."""
    cols = list(cols)
    aggs, pairs = [], []
    for a in range(len(cols)):
        for b in range(a + 1, len(cols)):
            x, y = F.col(cols[a]).cast("double"), F.col(cols[b]).cast("double")
            cov, sx, sy, n = _pair_exprs(x, y)
            k = f"p{a}_{b}"
            aggs.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(cols[a]).alias("feature1"),
                                 F.lit(cols[b]).alias("feature2"), F.try_divide(cov, sx * sy).alias("correlation"),
                                 n.alias("n")).alias(k))
            pairs.append(k)
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[F.col(k) for k in pairs])))


def corr_with_target(df: DataFrame, features: Sequence[str], targets: Sequence[str] = ("aqi", "pm2_5"),
                     by: Sequence[str] = ()) -> DataFrame:
    """R and |r| of each feature with each target (one pass), |r| descending per target."""
    parts = []
    for t in targets:
        for f in features:
            if f == t:
                continue
            parts.append(F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"),
                                  guarded_corr(F.col(f).cast("double"), F.col(t).cast("double")).alias("correlation")))
    wide = df.groupBy(*by).agg(*[p.alias(f"c{k}") for k, p in enumerate(parts)])
    long = wide.select(*by, F.inline(F.array(*[F.col(f"c{k}") for k in range(len(parts))])))
    return long.withColumn("abs_correlation", F.abs("correlation")).orderBy(*by, "target", F.desc_nulls_last("abs_correlation"), "feature")


def top_features(corr_long: DataFrame, k: int = 10, by: Sequence[str] = ("target",)) -> DataFrame:
    """The ``k`` features with the largest |r| per target (ties by feature name)."""
    w = Window.partitionBy(*by).orderBy(F.col("abs_correlation").desc_nulls_last(), F.col("feature"))
    return corr_long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quadratic_corr(df: DataFrame, features: Sequence[str], target: str = "aqi", first: int = 5,
                   factor: float = 1.2) -> DataFrame:
    """Flag features whose square correlates more strongly (|r(x^2, y)| > 1.2 |r(x, y)|)."""
    parts = []
    for f in list(features)[:first]:
        x, y = F.col(f).cast("double"), F.col(target).cast("double")
        parts.append(F.struct(F.lit(f).alias("feature"), F.abs(guarded_corr(x, y)).alias("abs_linear"),
                              F.abs(guarded_corr(F.pow(x, 2), y)).alias("abs_quadratic")))
    wide = df.agg(*[p.alias(f"c{k}") for k, p in enumerate(parts)])
    long = wide.select(F.inline(F.array(*[F.col(f"c{k}") for k in range(len(parts))])))
    return long.withColumn("nonlinear", F.col("abs_quadratic") > F.col("abs_linear") * factor)


def top_corr_pairs(corr_long: DataFrame, n: int = 20, by: Sequence[str] = ("city",)) -> DataFrame:
    """O3 + F6: the ``n`` largest |r| over all groups and pairs, with strength and direction."""
    out = corr_long.filter(F.col("correlation").isNotNull()).withColumn("abs_correlation", F.abs("correlation"))
    out = out.orderBy(F.col("abs_correlation").desc(), *by, "i", "j").limit(n)
    return out.withColumn("strength", corr_strength("correlation")).withColumn("direction",
                                                                             corr_direction("correlation"))


def strong_pairs(corr_long: DataFrame, threshold: float = 0.5, n: int = 5) -> DataFrame:
    """The first ``n`` pairs with |r| > threshold in column order (not by strength)."""
    return corr_long.filter(F.abs("correlation") > threshold).orderBy("i", "j").limit(n)


def corr_network(corr_long: DataFrame, threshold: float = 0.3, by: Sequence[str] = ("city",)) -> DataFrame:
    """X11: edges |r| > threshold with weight and sign."""
    return (corr_long.filter(F.abs("correlation") > threshold)
                     .select(*by, F.col("feature1").alias("src"), F.col("feature2").alias("dst"),
                             F.abs("correlation").alias("weight"),
                             F.when(F.col("correlation") > 0, 1).otherwise(-1).alias("sign")))


def node_degrees(edges: DataFrame, nodes: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """X11: degree of every node (all columns are nodes; isolated nodes have degree 0)."""
    ends = edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node")))
    deg = ends.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))
    node_arr = F.array(*[F.lit(x) for x in nodes])
    if by:
        grid = edges.select(*by).distinct().select(*by, F.explode(node_arr).alias("node"))
    else:  # one global graph: the node list is the (schema-sized) column list
        grid = edges.sparkSession.createDataFrame([(x,) for x in nodes], "node string")
    return join_null_safe(grid, deg, list(by) + ["node"], "left").fillna(0, ["degree"])


# --- X1 / X2 ------------------------------------------------------------------------------------------------


def iqr_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",), k: float = 1.5) -> DataFrame:
    """Per group and column: Q1, Q3, fences, outlier count and share."""
    if not by:
        return iqr_outliers(df.withColumn("__all", F.lit(0)), cols, ["__all"], k).drop("__all")
    long = unpivot(df, by, cols, "variable", "value").filter(F.col("value").isNotNull())
    keys = list(by) + ["variable"]
    q = quantile_columns(long, keys, "value", [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)
    j = attach(long, q, keys)
    out = (j.groupBy(*keys, "q1", "q3", "lower", "upper")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outliers")))
    return out.withColumn("outlier_percent", F.col("outliers") * 100.0 / F.col("n"))


def zscore_anomalies(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",), z: float = 3.0,
                     min_rows: int = 10) -> DataFrame:
    """Rows with any |z| > 3 (population std, per group); rows with a null in ``cols`` are
    dropped first; groups with ``min_rows`` rows or fewer are skipped; constant column -> z = 0."""
    if not by:
        return zscore_anomalies(df.withColumn("__all", F.lit(0)), cols, ["__all"], z, min_rows).drop("__all")
    d = df.na.drop(subset=list(cols))
    stats = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"),
                               *[F.avg(c).alias(f"__m_{c}") for c in cols],
                               *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    stats = stats.filter(F.col("__n") > min_rows)
    j = attach(d, stats, by)
    zs = [F.abs(F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0))) for c in cols]
    maxz = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return j.withColumn("max_abs_z", maxz).withColumn("is_anomaly", F.col("max_abs_z") > z).drop(
        "__n", *[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


# --- X4 ------------------------------------------------------------------------------------------------------


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function: the incomplete gamma function by its power series."""
    a, t = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= t / i
        total += term
    return total * exp(a * log(t) - t - lgamma(a)) if t > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    """Value below which a chi-squared variable with ``k`` degrees of freedom lies with probability ``p``."""
    low, high = 0.0, k + 10.0
    while _chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _location_scatter(rows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``__mean`` and ``__cov`` (population covariance, lower triangle by rows) of ``cols`` per group."""
    return rows.groupBy(*keys).agg(F.array(*[F.avg(c) for c in cols]).alias("__mean"),
                                   F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in _pairs(len(cols))]).alias("__cov"))


def _inverted(cov: str) -> Column:
    return F.pandas_udf(_inverses, "inverse array<double>, det double")(cov)


def _inverses(cov: pd.Series) -> pd.DataFrame:
    """Inverse (lower triangle) and determinant by the Cholesky factor; null where it does not exist.  One matrix a group."""
    out = []
    for flat in cov:
        p = int((sqrt(8 * len(flat) + 1) - 1) / 2)
        at, full = np.tril_indices(p), np.zeros((p, p))
        try:
            full[at] = np.array(flat, float)
            full = np.tril(full) + np.tril(full, -1).T
            root = np.linalg.cholesky(full)
            back = np.linalg.inv(root)
            out.append(((back.T @ back)[at], float(np.prod(np.diag(root)) ** 2)))
        except (np.linalg.LinAlgError, TypeError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["inverse", "det"])


def _with_distance(rows: DataFrame, est: DataFrame, keys: Sequence[str], cols: Sequence[str], into: str) -> DataFrame:
    """Rows with the squared Mahalanobis distance from their group's estimate; groups without an inverse are dropped.

    The distance comes out of a generator: the optimizer copies no filter on it below, where each mention would be
    a distance computed again, in a method too long to be compiled.
    """
    able = est.withColumn("__inv", _inverted("__cov")["inverse"]).where("__inv IS NOT NULL").drop("__cov")
    out = attach(rows, able, keys).withColumns({f"__z{i}": F.col(c) - F.get("__mean", F.lit(i)) for i, c in enumerate(cols)})
    total = F.lit(0.0)
    for at, (i, j) in enumerate(_pairs(len(cols))):
        total = total + (1.0 if i == j else 2.0) * F.get("__inv", F.lit(at)) * F.col(f"__z{i}") * F.col(f"__z{j}")
    return out.select(*rows.columns, F.explode(F.array(total)).alias(into))


def _first_estimates(d: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Three deterministic starts per group (``__start``): mean and covariance; medians and squared median
    absolute deviations; medians and the covariance of directions from them, scaled back."""
    p = len(cols)
    classical = _location_scatter(d, by, cols).withColumn("__start", F.lit(0))
    long = unpivot(d, by, cols, "__col", "__v")
    med = quantile_columns(long, [*by, "__col"], "__v", [0.5], ["__med"])
    dev = attach(long, med, [*by, "__col"]).withColumn("__dev", F.abs(F.col("__v") - F.col("__med")))
    both = join_null_safe(med, quantile_columns(dev, [*by, "__col"], "__dev", [0.5], ["__mad"]), [*by, "__col"])
    of = {x: F.array(*[F.max(F.when(F.col("__col") == c, F.col(x))) for c in cols]) for x in ("__med", "__mad")}
    wide = both.groupBy(*by).agg(of["__med"].alias("__mean"), of["__mad"].alias("__mad")).checkpoint(eager=True)

    def mad(i):
        return F.get("__mad", F.lit(i))
    diagonal = wide.select(*by, "__mean", F.array(*[mad(i) * mad(i) if i == j else F.lit(0.0) for i, j in _pairs(p)]).alias("__cov"), F.lit(1).alias("__start"))
    z = attach(d, wide, by).withColumns({f"__z{i}": F.try_divide(F.col(c) - F.get("__mean", F.lit(i)), mad(i)) for i, c in enumerate(cols)})
    square = F.lit(0.0)
    for i in range(p):
        square = square + F.col(f"__z{i}") * F.col(f"__z{i}")
    z = z.withColumn("__sq", square)
    signs = z.groupBy(*by).agg(F.array(*[F.avg(F.try_divide(F.col(f"__z{i}") * F.col(f"__z{j}"), F.col("__sq"))) for i, j in _pairs(p)]).alias("__sign"))
    signs = join_null_safe(wide, signs, by).select(
        *by, "__mean", F.array(*[F.get("__sign", F.lit(at)) * mad(i) * mad(j) for at, (i, j) in enumerate(_pairs(p))]).alias("__cov"), F.lit(2).alias("__start"))
    return classical.unionByName(diagonal).unionByName(signs)


#: Columns of the anomaly report, and the share of a chi-squared distribution that the last estimate is made from.
ENVELOPE_COLUMNS = ("temperature", "humidity", "pressure", "wind_speed", "aqi", "pm2_5")
REWEIGHT = 0.975


def elliptic_envelope(df: DataFrame, cols: Sequence[str] = ENVELOPE_COLUMNS, by: Sequence[str] = ("city",), contamination: float = 0.1,
                      steps: int = 4, min_rows: int = 10) -> DataFrame:
    """Rows with their squared Mahalanobis ``mahalanobis`` from a robust mean and covariance of ``cols``, the
    group's ``threshold`` (exact quantile at 1 - contamination) and ``is_outlier``.

    Minimum covariance determinant by concentration steps (Rousseeuw and Van Driessen 1999): from each of three
    deterministic starts, ``steps`` times, the rows at or below the group's exact median distance give the
    next mean and covariance; the start with the smallest determinant stays.  Its covariance is scaled so that
    the median distance is the chi-squared median (consistency at the normal), and rows within the 97.5 % point
    give the last estimate.  All starts take each step together, in one aggregate of p x p sums.  ``steps=0``
    is the classical estimate.  Rows with a null in ``cols`` are dropped; groups of ``min_rows`` rows or fewer
    are skipped, and so are groups whose covariance is singular in every start.  A null key is a group.
    """
    by, cols, p = list(by), list(cols), len(cols)
    if not by:
        return elliptic_envelope(df.withColumn("__all", F.lit(0)), cols, ["__all"], contamination, steps, min_rows).drop("__all")
    ensure_checkpoint_dir(df.sparkSession)
    d = df.na.drop(subset=cols)
    enough = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_rows).drop("__n")
    d = attach(d, enough, by, "left_semi")
    values = d.select(*by, *cols)
    if steps:  # many passes follow: each reads these columns, and not the table and what they are derived from
        values = values.repartition(df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)
    est = _location_scatter(values, by, cols)
    if steps:
        keys = [*by, "__start"]
        starts = values.withColumn("__start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        est = _first_estimates(values, by, cols).checkpoint(eager=True)
        for _ in range(steps):
            # the estimates are a few rows a group: cut here, each step starts from a short plan
            near = _with_distance(starts, est, keys, cols, "__d")
            cut = quantile_columns(near, keys, "__d", [0.5], ["__cut"])
            est = _location_scatter(attach(near, cut, keys).where(F.col("__d") <= F.col("__cut")), keys, cols).checkpoint(eager=True)
        best = est.withColumn("__det", _inverted("__cov")["det"]).where("__det IS NOT NULL").groupBy(*by).agg(F.min_by("__start", F.struct("__det", "__start")).alias("__start"))
        est = join_null_safe(est, best, keys, "left_semi").drop("__start")
        near = _with_distance(values, est, by, cols, "__d")
        scale = quantile_columns(near, by, "__d", [0.5], ["__cut"]).withColumn("__scale", F.col("__cut") / chi2_quantile(0.5, p)).drop("__cut")
        est = _location_scatter(attach(near, scale, by).where(F.col("__d") <= F.col("__scale") * chi2_quantile(REWEIGHT, p)), by, cols).checkpoint(eager=True)
    scored = _with_distance(d, est, by, cols, "mahalanobis")
    cut = quantile_columns(_with_distance(values, est, by, cols, "mahalanobis"), by, "mahalanobis", [1 - contamination], ["threshold"])
    return attach(scored, cut, by).withColumn("is_outlier", F.col("mahalanobis") > F.col("threshold"))


# --- X5 / X6 ------------------------------------------------------------------------------------------------


def jarque_bera(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """X5 (second form, any size): Jarque-Bera from population skewness / excess kurtosis:
    JB = n/6 (S^2 + K^2/4), p = exp(-JB/2); normal when p > 0.05."""
    long = unpivot(df, by, cols, "variable", "value")
    g = long.groupBy(*by, "variable").agg(F.count("value").alias("n"), F.skewness("value").alias("skew"),
                                          F.kurtosis("value").alias("excess_kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("excess_kurtosis") ** 2 / 4.0)
    return (g.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))
             .withColumn("is_normal", F.col("p_value") > 0.05))


# The normal quantile function (algorithm AS 241, Wichura 1988): numerators and denominators of
# its three rational functions, lowest power first; |p - 0.5| up to 0.425, then r = sqrt(-ln p) up to 5, then beyond.
NORMAL_QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
# The W test (algorithm AS R94, Royston 1995), polynomials with the lowest power first: corrections of
# the two outer weights in 1/sqrt(n); mean and log deviation of the transformed W in n up to 11, in ln n beyond; bounds.
W_OUTER, W_SECOND = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_SMALL_MEAN, W_SMALL_SD, W_SMALL_EDGE = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
W_LARGE_MEAN, W_LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
W_LEAST, W_MOST = 3, 5000
NORMAL_95 = 1.6448536269514722  # 95 % point of the normal distribution


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def with_normal_quantile(df: DataFrame, p: Column, into: str) -> DataFrame:
    """Adds the standard normal distribution's quantile at 0 < p < 1, to double precision; one column a step."""
    q = F.col("__q")
    d = (df.withColumn("__p", p).withColumn("__q", F.col("__p") - 0.5).withColumn("__root", F.sqrt(-F.ln(F.least(F.col("__p"), 1 - F.col("__p")))))
         .withColumn("__centre", 0.180625 - q * q).withColumn("__far", F.col("__root") - F.when(F.col("__root") <= 5.0, 1.6).otherwise(5.0)))
    (a, b), (c, e), (f, g) = NORMAL_QUANTILE
    centre, far = F.col("__centre"), F.col("__far")
    outer = F.when(F.col("__root") <= 5.0, _polynomial(c, far) / _polynomial(e, far)).otherwise(_polynomial(f, far) / _polynomial(g, far))
    return (d.withColumn("__outer", outer).withColumn(into, F.when(F.abs(q) <= 0.425, q * _polynomial(a, centre) / _polynomial(b, centre)).otherwise(F.signum(q) * F.col("__outer")))
            .drop("__p", "__q", "__root", "__centre", "__far", "__outer"))


def shapiro_wilk(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """Shapiro-Wilk per group and column: ``n, w, z, p_value, is_normal`` (p above 0.05).

    W is the squared sum of rank-weighted values over the sum of squares; weights follow Royston's
    approximation to the expected normal order statistics, ``z`` is his normalised 1 - W (null for n = 3, where
    p is exact).  Defined for 3 to 5,000 values, as published: outside, and for constant columns, the
    results are null.  So only groups of at most 5,000 values are put in value order, each in one task;
    larger ones are counted and never moved.  Null and NaN values are left out, a null key is a group.
    """
    keys = [*by, "variable"]
    long = unpivot(df, by, cols, "variable", "value").where("value IS NOT NULL AND NOT isnan(value)")
    size = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fit = size.where(F.col("n").between(W_LEAST, W_MOST))
    rows = attach(long, fit, keys).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("value")))
    n, i, m = F.col("n"), F.col("__i"), F.col("__m")

    def at(rank, value="value"):
        return F.max(F.when(i == rank, F.col(value)))
    inner = (i > 2) & (i < n - 1)
    g = with_normal_quantile(rows, (i - 0.375) / (n + 0.25), "__m").groupBy(*keys, "n").agg(
        F.sum(m * m).alias("__mm"), F.coalesce(F.sum(F.when(inner, m * F.col("value"))), F.lit(0.0)).alias("__inner"), (F.var_pop("value") * n).alias("__ss"),
        at(1).alias("__x1"), at(2).alias("__x2"), at(n - 1).alias("__y2"), at(n).alias("__y1"),
        at(n, "__m").alias("__m1"), at(n - 1, "__m").alias("__m2"))
    g = g.withColumn("__r", 1 / F.sqrt(n))
    g = g.withColumn("__a1", F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(_polynomial(W_OUTER, F.col("__r")) + F.col("__m1") / F.sqrt("__mm")))
    g = g.withColumn("__a2", F.when(n > 5, _polynomial(W_SECOND, F.col("__r")) + F.col("__m2") / F.sqrt("__mm")))
    m1, m2, a1, a2 = (2 * F.col(c) * F.col(c) for c in ("__m1", "__m2", "__a1", "__a2"))
    g = g.withColumn("__fac", F.when(n > 5, F.sqrt((F.col("__mm") - m1 - m2) / (1 - a1 - a2))).when(n > 3, F.sqrt((F.col("__mm") - m1) / (1 - a1))))
    second = F.when(n > 5, F.col("__a2")).when(n > 3, F.col("__m2") / F.col("__fac")).otherwise(F.lit(0.0))
    total = F.col("__a1") * (F.col("__y1") - F.col("__x1")) + second * (F.col("__y2") - F.col("__x2")) + F.when(n > 5, F.col("__inner") / F.col("__fac")).otherwise(F.lit(0.0))
    g = g.withColumn("__t", total).withColumn("w", F.when(F.col("__ss") > 0, F.least(F.lit(1.0), F.col("__t") * F.col("__t") / F.col("__ss"))))
    y, size_log = F.ln(1 - F.col("w")), F.ln(n)
    edge = _polynomial(W_SMALL_EDGE, n)
    small = F.when(y < edge, (-F.ln(edge - y) - _polynomial(W_SMALL_MEAN, n)) / F.exp(_polynomial(W_SMALL_SD, n))).otherwise(F.lit(float("inf")))
    g = g.withColumn("z", F.when(n > 11, (y - _polynomial(W_LARGE_MEAN, size_log)) / F.exp(_polynomial(W_LARGE_SD, size_log))).when(n > 3, small))
    exact = F.greatest(F.lit(0.0), 6 / pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))

    @F.pandas_udf("double")
    def above(z: pd.Series) -> pd.Series:  # one value a group
        return z.map(lambda v: None if v is None or v != v else erfc(v / sqrt(2)) / 2)
    found = g.withColumn("p_value", F.when(n == 3, exact).otherwise(above("z")))
    found = found.withColumn("is_normal", F.when(n == 3, F.col("p_value") > 0.05).otherwise(F.col("z") < NORMAL_95))
    return join_null_safe(size, found.select(*keys, "w", "z", "p_value", "is_normal"), keys, "left")


DF_CRITICAL_5PCT = -2.86  # published 5 % critical value, constant-only Dickey-Fuller regression


def dickey_fuller(df: DataFrame, cols: str | Sequence[str], by: Sequence[str] = ("city",), order: str = "timestamp",
                  bucket=("hour", "day")) -> DataFrame:
    """X6 without lagged differences: t of y_{t-1} in  dy_t = a + b y_{t-1}  per series and column
    (``series``), all columns in one pass."""
    from aerolith.operators.windows import series_shift
    cols = [cols] if isinstance(cols, str) else list(cols)
    d = series_shift(df.select(*by, order, *cols), by, order, lambda w: {f"__p_{c}": F.lag(c, 1).over(w) for c in cols}, back=1, bucket=bucket)
    aggs = []
    for c in cols:
        dy, prev = F.col(c) - F.col(f"__p_{c}"), F.col(f"__p_{c}")
        aggs.append(F.struct(F.lit(c).alias("series"), F.regr_count(dy, prev).alias("n"), F.regr_slope(dy, prev).alias("slope"),
                             F.regr_sxx(dy, prev).alias("__sxx"), F.regr_syy(dy, prev).alias("__syy")).alias(f"__{c}"))
    g = d.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*[F.col(f"__{c}") for c in cols])))
    sse = F.col("__syy") - F.col("slope") * F.col("slope") * F.col("__sxx")
    se = F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("__sxx")))
    return (g.withColumn("t_stat", F.try_divide(F.col("slope"), se))
             .withColumn("is_stationary", F.col("t_stat") < DF_CRITICAL_5PCT).drop("__sxx", "__syy"))


# MacKinnon's surfaces for one series with a constant.  p-value (1994): the normal distribution at
# a polynomial of the statistic, one below and one above the switch, 0 and 1 outside the bounds.
# Critical values (2010): polynomials in 1/n for 1, 5 and 10 %.
ADF_SWITCH, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
ADF_BELOW, ADF_ABOVE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.040), 10: (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p_value(t: float) -> float:
    """Approximate p-value of the Dickey-Fuller t with a constant."""
    if t > ADF_MOST:
        return 1.0
    if t < ADF_LEAST:
        return 0.0
    z = sum(c * t ** i for i, c in enumerate(ADF_BELOW if t <= ADF_SWITCH else ADF_ABOVE))
    return erfc(-z / sqrt(2)) / 2


def schwert_lag(n: int) -> int:
    """Most lagged differences tried for a series of ``n`` values: 12 (n / 100)^(1/4), at most what leaves degrees of freedom."""
    return max(0, min(ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def _regression_t(gram: np.ndarray, lags: int) -> tuple[float, float, int]:
    """(t of the level, residual sum of squares, rows) of dy on 1, level and ``lags`` differences.

    ``gram`` holds the sums of products of (1, level, difference 1 .. k, dy).  Raises LinAlgError where it is singular.
    """
    at = [0, 1, *range(2, 2 + lags)]
    n, xx, xy, yy = int(round(gram[0, 0])), gram[np.ix_(at, at)], gram[at, -1], gram[-1, -1]
    mean, mean_y = xx[0, 1:] / n, xy[0] / n  # the constant is projected out, which keeps digits
    xx, xy, yy = xx[1:, 1:] - n * np.outer(mean, mean), xy[1:] - n * mean * mean_y, yy - n * mean_y * mean_y
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    rss = yy - beta @ xy
    freedom = n - len(at)
    return (float(beta[0] / sqrt(rss / freedom * inverse[0, 0])) if freedom > 0 and rss > 0 else float("nan")), float(rss), n


def choose_and_test(gram: np.ndarray, heads: list[np.ndarray], n: int) -> tuple[int, float, int] | None:
    """(lag, t, rows used) of a series of ``n`` values; ``heads`` are its first rows, which lack some lags (NaN).

    Every lag up to the Schwert bound is fitted to the rows that have them all, from sub-matrices of one Gram
    matrix; the lowest AIC wins (ties: fewer lags) and is fitted again to all rows that have its lags.
    """
    def with_heads(lags: int) -> np.ndarray:
        out = gram.copy()
        at = [0, 1, *range(2, 2 + lags), len(gram) - 1]
        for row in heads:
            if not np.isnan(row[at]).any():
                out[np.ix_(at, at)] += np.outer(row[at], row[at])
        return out
    most = min(schwert_lag(n), len(gram) - 3)
    whole, best = with_heads(most), None
    try:
        for lags in range(most + 1):
            _, rss, rows = _regression_t(whole, lags)
            aic = rows * (log(2 * pi) + log(rss / rows) + 1) + 2 * (lags + 2)
            if best is None or aic < best[0]:
                best = aic, lags
        t, _, rows = _regression_t(with_heads(best[1]), best[1])
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return None
    return None if t != t else (best[1], t, rows)


def augmented_dickey_fuller(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("city",), order: str = "timestamp", max_lag: int | None = None,
                            min_rows: int = 10, bucket=("hour", "day")) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant per series and column: ``series, n, used_lag, n_used, t_stat,
    p_value, critical_1, critical_5, critical_10, is_stationary`` (p below 0.05).

    Null values are left out before differencing; series of ``min_rows`` values or fewer are skipped, and a
    series whose regression is singular (constant) has null results.  ``order`` is unique in a series.  The lag is
    chosen by AIC up to the Schwert bound of each series' length, ``max_lag`` at most.  All columns and lags take one pass over the
    rows: each task adds up the products of (1, level, lagged differences, difference) of its rows into one
    small matrix a series, the matrices are summed, and only these and each series' first rows, which lack
    some lags, reach the test.  Without ``max_lag`` the longest series' length is counted first.
    """
    from aerolith.operators.windows import series_shift
    keys = [*by, "series"]
    long = unpivot(df.select(*by, order, *cols), [*by, order], cols, "series", "__y").where("__y IS NOT NULL AND NOT isnan(__y)")
    if max_lag is None:
        longest = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        max_lag = schwert_lag(longest)
    k = max_lag
    d = series_shift(long, keys, order, lambda w: {"__past": F.collect_list("__y").over(w.rowsBetween(-(k + 1), 0))}, back=k + 1, bucket=bucket, keep_index=True)
    size = d.groupBy(*keys).agg(F.max("rn").cast("long").alias("n")).where(F.col("n") > min_rows)
    d = d.where("rn > 1").select(*keys, "rn", "__past")
    width = k + 3
    key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in keys)

    def vectors(past: np.ndarray) -> np.ndarray:
        diff = np.diff(past, axis=1)
        return np.column_stack([np.ones(len(past)), past[:, -2], diff[:, -2::-1] if diff.shape[1] > 1 else np.empty((len(past), 0)), diff[:, -1]])

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            names = own.select(keys).to_pylist()
            of: dict[tuple, list[int]] = {}
            for at, name in enumerate(names):
                of.setdefault(tuple(name.values()), []).append(at)
            rank, past = own.column("rn").to_numpy(), own.column("__past").to_pylist()
            found: list[tuple] = []
            for key, at in of.items():
                full = [past[i] for i in at if rank[i] >= k + 2]
                if full:
                    v = vectors(np.array(full))
                    found.append((*key, (v.T @ v).ravel().tolist(), None))
                for i in at:
                    if rank[i] < k + 2:
                        v, row = vectors(np.array([past[i]]))[0], np.full(width, np.nan)
                        row[:len(v) - 1], row[-1] = v[:-1], v[-1]
                        found.append((*key, None, row.tolist()))
            out = pa.schema([*(own.schema.field(c) for c in keys), ("gram", pa.list_(pa.float64())), ("head", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*found), out)], schema=out)
    parts = d.mapInArrow(sums, f"{key_type}, gram array<double>, head array<double>")
    # matrices are summed cell by cell, combined before the shuffle; at most k + 1 heads a series are listed
    cells = (parts.where("gram IS NOT NULL").select(*keys, F.posexplode("gram").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
             .groupBy(*keys).agg(F.collect_list(F.struct("at", "x")).alias("cells")))
    heads = parts.where("head IS NOT NULL").groupBy(*keys).agg(F.collect_list("head").alias("heads"))
    rows = join_null_safe(join_null_safe(size, heads, keys, "left"), cells, keys, "left")

    @F.pandas_udf("used_lag long, n_used long, t_stat double, p_value double, critical_1 double, critical_5 double, critical_10 double")
    def test(n: pd.Series, heads: pd.Series, cells: pd.Series) -> pd.DataFrame:
        out = []
        for size_, head, cell in zip(n, heads, cells):
            gram = np.zeros(width * width)
            for c in cell if cell is not None else ():
                gram[c["at"]] = c["x"]
            got = choose_and_test(gram.reshape(width, width), [np.array(h, float) for h in head] if head is not None else [], int(size_))
            if got is None:
                out.append((None,) * 7)
                continue
            lag, t, rows_ = got
            out.append((lag, rows_, t, adf_p_value(t), *(sum(c / rows_ ** i for i, c in enumerate(ADF_CRITICAL[level])) for level in (1, 5, 10))))
        names = ["used_lag", "n_used", "t_stat", "p_value", "critical_1", "critical_5", "critical_10"]
        return pd.DataFrame(out, columns=names).astype({"used_lag": "Int64", "n_used": "Int64"})
    return (rows.withColumn("__t", test("n", "heads", "cells")).select(*keys, "n", "__t.*")
            .withColumn("is_stationary", F.col("p_value") < 0.05))


# --- X7 -----------------------------------------------------------------------------------------------------


def seasonal_decompose(series: DataFrame, col: str, period: int = 7, by: Sequence[str] = ("city",),
                       order: str = "date") -> DataFrame:
    """Additive decomposition with a centred moving average (odd ``period``).

    ``series`` is already aggregated (e.g. daily means), so its size is keys x
    periods; trend is null unless the full window exists; seasonal is the mean
    detrended value per phase minus the mean of those phase means.
    """
    if period % 2 == 0:
        raise ValueError("odd period expected")
    h = period // 2
    d = with_row_index(series, by, order, bucket=None, index="__pos", total="__n")
    w = Window.partitionBy(*by).orderBy("__pos").rowsBetween(-h, h)
    d = d.withColumn("trend", F.when(F.count(col).over(w) == period, F.avg(col).over(w)))
    d = d.withColumn("__phase", F.pmod(F.col("__pos") - 1, F.lit(period)))
    ph = (d.groupBy(*by, "__phase").agg(F.avg(F.col(col) - F.col("trend")).alias("__pm")))
    ph = ph.withColumn("seasonal", F.col("__pm") - F.avg("__pm").over(Window.partitionBy(*by)))
    out = join_null_safe(d, ph.drop("__pm"), list(by) + ["__phase"], "left")
    return out.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal")).drop("__n")\
              .withColumnRenamed("__pos", "position").withColumnRenamed("__phase", "phase")
