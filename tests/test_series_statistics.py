"""Envelope, normality and stationarity tests against plain NumPy forms."""

from math import erfc, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pytest

from aerolith.operators import stats as X
from aerolith.operators import windows as W


# --- X4 ----------------------------------------------------------------------------------------------------------

def plain_envelope(x, steps):
    p, best = x.shape[1], None
    med = np.median(x, 0)
    mad = np.median(np.abs(x - med), 0)
    z = (x - med) / mad
    sign = (z[:, :, None] * z[:, None, :] / (z * z).sum(1)[:, None, None]).mean(0) * np.outer(mad, mad)

    def distance(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    for mean, cov in ((x.mean(0), np.cov(x.T, ddof=0)), (med, np.diag(mad ** 2)), (med, sign)):
        for _ in range(steps):
            d = distance(mean, cov)
            own = x[d <= np.median(d)]
            mean, cov = own.mean(0), np.cov(own.T, ddof=0)
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov
    d = distance(*best[1:])
    own = x[d <= np.median(d) / X.chi2_quantile(0.5, p) * X.chi2_quantile(0.975, p)]
    return distance(own.mean(0), np.cov(own.T, ddof=0))


def test_envelope_of_six_columns_equals_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    groups = {"a": rng.normal(size=(400, 6)) @ mix, None: rng.normal(size=(150, 6)) * 3 + 50, "few": rng.normal(size=(9, 6)), "flat": np.column_stack([rng.normal(size=(60, 5)), np.ones(60)])}
    groups["a"][:40] += 60  # a far cluster must not pull the estimate
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)] + [("a", 999, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "city string, i int, " + ", ".join(f"{c} double" for c in X.ENVELOPE_COLUMNS))
    got = {}
    for r in X.elliptic_envelope(df, steps=3).collect():
        got.setdefault(r.city, {})[r.i] = (r.mahalanobis, r.threshold, r.is_outlier)
    assert set(got) == {"a", None}
    for g in ("a", None):
        want = plain_envelope(groups[g], 3)
        assert len(got[g]) == len(want)
        for i, w in enumerate(want):
            assert abs(got[g][i][0] - w) < 1e-6 * max(1, w)
            assert got[g][i][2] == (w > np.quantile(want, 0.9) * (1 + 1e-12)) or abs(w - np.quantile(want, 0.9)) < 1e-6
    assert all(got["a"][i][2] for i in range(40))  # a tenth of the rows: all of the far ones


def test_chi_squared_points():
    assert abs(X.chi2_quantile(0.5, 2) - 2 * log(2)) < 1e-12 and abs(X.chi2_quantile(0.95, 1) - 3.841458820694124) < 1e-9


# --- X5 ----------------------------------------------------------------------------------------------------------

def plain_shapiro(x):
    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / sqrt(n), (m ** 2).sum()

    def poly(c, v):
        return sum(k * v ** i for i, k in enumerate(c))
    a = np.zeros(n)
    if n == 3:
        a[:] = -sqrt(0.5), 0, sqrt(0.5)
    else:
        last = poly(X.W_OUTER, u) + m[-1] / sqrt(mm)
        if n > 5:
            second = poly(X.W_SECOND, u) + m[-2] / sqrt(mm)
            a = m / sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2))
            a[-2], a[1] = second, -second
        else:
            a = m / sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last ** 2))
        a[-1], a[0] = last, -last
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / pi * (np.arcsin(sqrt(w)) - np.arcsin(sqrt(0.75))))
    y = log(1 - w)
    if n <= 11:
        edge = poly(X.W_SMALL_EDGE, n)
        if y >= edge:
            return w, 0.0
        z = (-log(edge - y) - poly(X.W_SMALL_MEAN, n)) / np.exp(poly(X.W_SMALL_SD, n))
    else:
        z = (y - poly(X.W_LARGE_MEAN, log(n))) / np.exp(poly(X.W_LARGE_SD, log(n)))
    return w, erfc(z / sqrt(2)) / 2


def test_shapiro_wilk_equals_the_plain_form(spark):
    rng = np.random.default_rng(2)
    groups = {f"n{n}": rng.normal(5, 2, n) for n in (3, 4, 5, 6, 11, 12, 50, 700)} | {"exp": rng.exponential(1, 200), None: rng.uniform(size=30), "top": rng.normal(size=5000)}
    other = {"flat": np.ones(20), "two": np.array([1.0, 2.0]), "large": rng.normal(size=5001)}
    rows = [(g, float(v)) for g, x in {**groups, **other}.items() for v in x] + [("n50", None), ("n50", float("nan"))]
    got = {r.city: r for r in X.shapiro_wilk(spark.createDataFrame(rows, "city string, v double").repartition(3), ["v"]).collect()}
    assert set(got) == {*groups, *other}
    for g, x in groups.items():
        w, p = plain_shapiro(x)
        assert got[g].n == len(x) and abs(got[g].w - w) < 1e-9 and abs(got[g].p_value - p) < 1e-6, g
        assert got[g].is_normal == (p > 0.05)
    assert all(got[g].w is None and got[g].p_value is None and got[g].n == len(x) for g, x in other.items())


def test_published_shapiro_example():
    # weights of eleven men, a textbook case: W = 0.79, p = 0.007
    w, p = plain_shapiro(np.array([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert abs(w - 0.79) < 0.005 and abs(p - 0.0067) < 0.001


# --- X6 ----------------------------------------------------------------------------------------------------------

def plain_fit(y, lags, skip):
    dy = np.diff(y)
    at = np.arange(max(skip, lags), len(dy))
    x = np.column_stack([np.ones(len(at)), y[at], *[dy[at - j] for j in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(x, dy[at], rcond=None)
    rss = ((dy[at] - x @ beta) ** 2).sum()
    n = len(at)
    t = beta[1] / sqrt(rss / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return t, n * (log(2 * pi) + log(rss / n) + 1) + 2 * x.shape[1], n


def plain_adf(y, most):
    most = min(most, X.schwert_lag(len(y)))
    lag = min(range(most + 1), key=lambda k: (plain_fit(y, k, most)[1], k))
    t, _, n = plain_fit(y, lag, 0)
    return lag, n, t


def series(rng, n, phi):
    e, y = rng.normal(size=n), np.zeros(n)
    for i in range(2, n):
        y[i] = y[i - 1] * phi + 0.3 * (y[i - 1] - y[i - 2]) + e[i]
    return y + 100


def test_augmented_dickey_fuller_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    groups = {"a": series(rng, 700, 0.9), "walk": series(rng, 300, 1.0), None: series(rng, 60, 0.2), "short": series(rng, 12, 0.5), "tiny": series(rng, 10, 0.5), "flat": np.full(40, 7.0)}
    rows = [(g, i, float(v), float(v * v)) for g, y in groups.items() for i, v in enumerate(y)] + [("a", -5, None, None)]
    df = spark.createDataFrame(rows, "city string, i int, u double, v double").selectExpr("city", "timestamp_ntz'2024-01-01' + make_dt_interval(0, i) AS timestamp", "u", "v")
    got = {(r.city, r.series): r for r in X.augmented_dickey_fuller(df.repartition(4), ["u", "v"]).collect()}
    assert set(got) == {(g, c) for g in groups if g != "tiny" for c in "uv"}
    most = X.schwert_lag(700)
    for g in ("a", "walk", None, "short"):
        for c in "uv":
            lag, n, t = plain_adf(groups[g] if c == "u" else groups[g] ** 2, most)
            r = got[g, c]
            assert (r.used_lag, r.n_used, r.n) == (lag, n, len(groups[g])) and abs(r.t_stat - t) < 1e-6 * max(1, abs(t)), (g, c, r, lag, t)
            assert r.is_stationary == (r.p_value < 0.05)
    assert got["a", "u"].is_stationary and not got["walk", "u"].is_stationary and got["flat", "u"].t_stat is None
    fixed = {r.city: r for r in X.augmented_dickey_fuller(df, ["u"], max_lag=0).collect()}
    assert all(fixed[g].used_lag == 0 and abs(fixed[g].t_stat - plain_fit(groups[g], 0, 0)[0]) < 1e-6 for g in ("a", "walk"))


@pytest.mark.parametrize("lags", range(9))
def test_gram_matrix_gives_every_lag(lags):
    y, k = series(np.random.default_rng(4), 120, 0.8), 8
    dy = np.diff(y)
    rows = np.array([[1, y[i], *[dy[i - j] if i >= j else np.nan for j in range(1, k + 1)], dy[i]] for i in range(len(dy))])
    whole = rows[~np.isnan(rows).any(1)]
    t, _, n = X._regression_t(whole.T @ whole, lags)
    want = plain_fit(y, lags, k)
    assert n == want[2] and abs(t - want[0]) < 1e-8


def test_published_p_values():
    assert abs(X.adf_p_value(-2.86) - 0.05) < 0.002 and abs(X.adf_p_value(-3.43) - 0.01) < 0.001 and X.adf_p_value(3) == 1 and X.adf_p_value(-30) == 0


# --- W7 ----------------------------------------------------------------------------------------------------------

def test_recent_trend_reads_only_the_tail(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=500).tolist(), None: rng.normal(size=30).tolist(), "b": [None, 1.0, None], "c": [None] * 4}
    rows = [(g, i, v) for g, y in groups.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "city string, timestamp int, aqi double").repartition(6)
    out = W.recent_trend(df, n=24)
    got = {r.city: r.recent_trend for r in out.collect()}
    for g, y in groups.items():
        tail = [v for v in y[-48:]]
        last, first = [v for v in tail[-24:] if v is not None], [v for v in tail[:24] if v is not None]
        assert got[g] is None if not last or not first else abs(got[g] - (np.mean(last) - np.mean(first))) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") == 2 and "Join" not in plan
