"""Registered correlation / statistics queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import aggregates as A
from aerolith.operators import stats as X
from aerolith.plans.registry import HOURLY_CTE, READINGS_CTE, d, dt, finish, i, register
from aerolith.sources.testdata import hourly, readings

COLS = ["aqi", "pm2_5", "pm10", "temperature", "humidity", "no2", "o3"]
PAIRS = [(a, b) for a in range(len(COLS)) for b in range(a + 1, len(COLS))]


def _corr_sql(x, y):
    return (f"CASE WHEN stddev_samp({x}) * stddev_samp({y}) = 0 THEN NULL "
            f"ELSE covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END")


def _pairs_sql(group="city"):
    sel = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {sel}{a} AS i, {b} AS j, '{COLS[a]}' AS feature1, '{COLS[b]}' AS feature2, "
        f"{_corr_sql(COLS[a], COLS[b])} AS correlation, count(*) AS n FROM readings{gb}" for a, b in PAIRS)


def _corr(spark, sf, by=("city",)):
    return X.corr_matrix(readings(spark, sf), COLS, by=by)


@register("a22_corr_matrix", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql()})
SELECT city, {i('i', 'i')}, {i('j', 'j')}, feature1, feature2, {d('correlation', 'correlation')}, {i('n', 'n')} FROM c""")
def q_a22(spark, sf):
    return finish(_corr(spark, sf))


_TGT = [(t, f) for t in ("aqi", "pm2_5") for f in COLS if f != t]


@register("a23_corr_with_target", f"""WITH {READINGS_CTE}, c AS ({' UNION ALL '.join(
    f"SELECT '{t}' AS target, '{f}' AS feature, {_corr_sql(f, t)} AS correlation FROM readings" for t, f in _TGT)})
SELECT target, feature, {d('correlation', 'correlation')}, {d('abs(correlation)', 'abs_correlation')} FROM c""")
def q_a23(spark, sf):
    return finish(X.corr_with_target(readings(spark, sf), COLS))


@register("o4_top_features", f"""WITH {READINGS_CTE}, c AS ({' UNION ALL '.join(
    f"SELECT '{t}' AS target, '{f}' AS feature, {_corr_sql(f, t)} AS correlation FROM readings" for t, f in _TGT)}),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(correlation) DESC NULLS LAST, feature) AS rank FROM c)
SELECT target, feature, {d('correlation', 'correlation')}, {d('abs(correlation)', 'abs_correlation')}, {i('rank', 'rank')}
FROM r WHERE rank <= 10""")
def q_o4(spark, sf):
    return finish(X.top_features(X.corr_with_target(readings(spark, sf), COLS), k=10))


_Q5 = COLS[1:6]


@register("a24_quadratic_corr", f"""WITH {READINGS_CTE}, c AS ({' UNION ALL '.join(
    f"SELECT '{f}' AS feature, abs({_corr_sql(f, 'aqi')}) AS abs_linear, abs({_corr_sql(f'pow({f}, 2)', 'aqi')}) AS abs_quadratic FROM readings"
    for f in _Q5)})
SELECT feature, {d('abs_linear', 'abs_linear')}, {d('abs_quadratic', 'abs_quadratic')}, abs_quadratic > abs_linear * 1.2 AS nonlinear FROM c""")
def q_a24(spark, sf):
    return finish(X.quadratic_corr(readings(spark, sf), _Q5, "aqi"))


@register("o3_top_corr_pairs", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql()})
SELECT city, {i('i', 'i')}, {i('j', 'j')}, feature1, feature2, {d('correlation', 'correlation')}, {i('n', 'n')},
       {d('abs(correlation)', 'abs_correlation')},
       CASE WHEN abs(correlation) > 0.7 THEN 'Strong' WHEN abs(correlation) > 0.5 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN correlation > 0 THEN 'Positive' ELSE 'Negative' END AS direction
FROM c WHERE correlation IS NOT NULL ORDER BY abs(correlation) DESC, city, i, j LIMIT 20""")
def q_o3(spark, sf):
    return finish(X.top_corr_pairs(_corr(spark, sf)))


@register("o5_strong_pairs", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql(None)})
SELECT {i('i', 'i')}, {i('j', 'j')}, feature1, feature2, {d('correlation', 'correlation')}, {i('n', 'n')}
FROM c WHERE abs(correlation) > 0.5 ORDER BY i, j LIMIT 5""")
def q_o5(spark, sf):
    return finish(X.strong_pairs(_corr(spark, sf, by=())))


@register("x11_corr_network", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql()})
SELECT city, feature1 AS src, feature2 AS dst, {d('abs(correlation)', 'weight')},
       {i('CASE WHEN correlation > 0 THEN 1 ELSE -1 END', 'sign')} FROM c WHERE abs(correlation) > 0.3""")
def q_x11(spark, sf):
    return finish(X.corr_network(_corr(spark, sf)))


_NODES = ", ".join(f"('{c}')" for c in COLS)


@register("x11_node_degrees", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql()}),
e AS (SELECT city, feature1 AS src, feature2 AS dst FROM c WHERE abs(correlation) > 0.3),
ends AS (SELECT city, src AS node FROM e UNION ALL SELECT city, dst FROM e),
g AS (SELECT DISTINCT city FROM e), nodes AS (SELECT * FROM (VALUES {_NODES}) t(node))
SELECT g.city, nodes.node, {i('(SELECT count(*) FROM ends WHERE ends.city = g.city AND ends.node = nodes.node)', 'degree')}
FROM g, nodes""")
def q_x11d(spark, sf):
    return finish(X.node_degrees(X.corr_network(_corr(spark, sf)), COLS))


_X1 = ["aqi", "pm2_5", "pm10", "no2"]


@register("x1_iqr_outliers", f"""WITH {READINGS_CTE},
l AS (UNPIVOT (SELECT city, {', '.join(_X1)} FROM readings) ON {', '.join(_X1)} INTO NAME variable VALUE value),
q AS (SELECT city, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT q.city, q.variable, {d('q1', 'q1')}, {d('q3', 'q3')}, {d('q1 - 1.5 * (q3 - q1)', 'lower')},
       {d('q3 + 1.5 * (q3 - q1)', 'upper')}, {i('count(*)', 'n')},
       {i('count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))', 'outliers')},
       {d('count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*)', 'outlier_percent')}
FROM l JOIN q USING (city, variable) GROUP BY q.city, q.variable, q1, q3""")
def q_x1(spark, sf):
    return finish(X.iqr_outliers(readings(spark, sf), _X1))


_Z = ["aqi", "pm2_5", "temperature", "humidity", "no2"]


@register("x2_zscore_anomalies", f"""WITH {READINGS_CTE},
st AS (SELECT city, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)}
       FROM readings GROUP BY city HAVING count(*) > 10),
z AS (SELECT r.city, greatest({', '.join(f'abs(coalesce(CASE WHEN s_{c} = 0 THEN NULL ELSE (r.{c} - m_{c}) / s_{c} END, 0))' for c in _Z)}) AS mz
      FROM readings r JOIN st USING (city))
SELECT city, {i('count(*)', 'n')}, {i('count(*) FILTER (WHERE mz > 3)', 'anomalies')}, {d('max(mz)', 'max_abs_z')} FROM z GROUP BY city""")
def q_x2(spark, sf):
    z = X.zscore_anomalies(readings(spark, sf), _Z)
    return finish(z.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"),
                                        F.max("max_abs_z").alias("max_abs_z")))


@register("x4_elliptic_envelope", f"""WITH {READINGS_CTE},
st AS (SELECT city, avg(aqi) AS ma, avg(pm2_5) AS mb, var_pop(aqi) AS vaa, var_pop(pm2_5) AS vbb, covar_pop(aqi, pm2_5) AS vab
       FROM readings GROUP BY city),
m AS (SELECT r.city, (vbb * (aqi - ma) * (aqi - ma) - 2 * vab * (aqi - ma) * (pm2_5 - mb) + vaa * (pm2_5 - mb) * (pm2_5 - mb))
             / (vaa * vbb - vab * vab) AS dist FROM readings r JOIN st USING (city)),
t AS (SELECT city, quantile_cont(dist, 0.9) AS threshold FROM m GROUP BY city)
SELECT city, {i('count(*)', 'n')}, {i('count(*) FILTER (WHERE dist > threshold)', 'outliers')}, {d('max(threshold)', 'threshold')}
FROM m JOIN t USING (city) GROUP BY city""")
def q_x4(spark, sf):
    e = X.elliptic_envelope(readings(spark, sf), ["aqi", "pm2_5"], steps=0)
    return finish(e.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("outliers"),
                                        F.max("threshold").alias("threshold")))


# Chi-squared points for six columns, the median and the 97.5 % point.
_ENV, _CHI2_MEDIAN, _CHI2_FAR, _STEPS = ["temperature", "humidity", "pressure", "wind_speed", "aqi", "pm2_5"], 5.348120627447116, 14.449375335447922, 3


def _scatter_sql(rows: str, keys: str, where: str = "") -> str:
    sums = [f"avg({c}) AS m{i}" for i, c in enumerate(_ENV)]
    sums += [f"covar_pop({_ENV[i]}, {_ENV[j]}) AS c{i}{j}" for i in range(6) for j in range(i + 1)]
    return f"SELECT {keys}, {', '.join(sums)} FROM {rows} {where} GROUP BY {keys}"


def _cholesky_sql(est: str) -> str:
    sql = f"SELECT * FROM {est}"
    for i in range(6):
        for j in range(i + 1):
            left = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            sql = f"SELECT *, {f'CASE WHEN {left} > 0 THEN sqrt({left}) END' if i == j else f'({left}) / nullif(l{j}{j}, 0)'} AS l{i}{j} FROM ({sql})"
    return f"SELECT *, {' * '.join(f'l{i}{i} * l{i}{i}' for i in range(6))} AS det FROM ({sql})"


def _distance_sql(rows: str, est: str, keys: list[str]) -> str:
    own = ", ".join([*keys, *_ENV])
    sql = (f"SELECT {', '.join(f'a.{x}' for x in [*keys, *_ENV])}, b.* EXCLUDE ({', '.join(keys)}) FROM {rows} a JOIN ({_cholesky_sql(est)}) b "
           f"ON {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in keys)} WHERE det IS NOT NULL")
    for i, c in enumerate(_ENV):
        sql = f"SELECT *, ({c} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) + f") / l{i}{i} AS z{i} FROM ({sql})"
    return f"SELECT {own}, {' + '.join(f'z{i} * z{i}' for i in range(6))} AS dist FROM ({sql})"


def _robust_sql() -> str:
    """The envelope of six columns: three starts, concentration steps, scaling, one reweighting."""
    med = ", ".join(f"quantile_cont({c}, 0.5) AS d{i}" for i, c in enumerate(_ENV))
    mad = ", ".join(f"quantile_cont(abs({c} - d{i}), 0.5) AS s{i}" for i, c in enumerate(_ENV))
    diag = ", ".join([f"d{i} AS m{i}" for i in range(6)] + [f"{f's{i} * s{i}' if i == j else '0.0'} AS c{i}{j}" for i in range(6) for j in range(i + 1)])
    unit = ", ".join(f"({c} - d{i}) / nullif(s{i}, 0) AS u{i}" for i, c in enumerate(_ENV))
    square = " + ".join(f"u{i} * u{i}" for i in range(6))
    sign = ", ".join([f"any_value(d{i}) AS m{i}" for i in range(6)]
                     + [f"avg(u{i} * u{j} / nullif({square}, 0)) * any_value(s{i}) * any_value(s{j}) AS c{i}{j}" for i in range(6) for j in range(i + 1)])
    ctes = [f"v AS (SELECT city, {', '.join(_ENV)} FROM readings)", f"md AS (SELECT city, {med} FROM v GROUP BY city)",
            f"ms AS (SELECT city, {', '.join(f'any_value(d{i}) AS d{i}' for i in range(6))}, {mad} FROM v JOIN md USING (city) GROUP BY city)",
            f"e0 AS MATERIALIZED (SELECT 0 AS st, * FROM ({_scatter_sql('v', 'city')}) UNION ALL SELECT 1, city, {diag} FROM ms "
            f"UNION ALL SELECT 2, city, {sign} FROM (SELECT *, {unit} FROM v JOIN ms USING (city)) GROUP BY city)",
            "vs AS (SELECT v.*, unnest([0, 1, 2]) AS st FROM v)"]
    for k in range(_STEPS):
        ctes += [f"r{k} AS MATERIALIZED ({_distance_sql('vs', f'e{k}', ['city', 'st'])})", f"q{k} AS (SELECT city, st, quantile_cont(dist, 0.5) AS cut FROM r{k} GROUP BY 1, 2)",
                 f"e{k + 1} AS MATERIALIZED ({_scatter_sql(f'r{k} JOIN q{k} USING (city, st)', 'city, st', 'WHERE dist <= cut')})"]
    ctes += [f"b AS (SELECT city, st FROM (SELECT city, st, row_number() OVER (PARTITION BY city ORDER BY det, st) AS rn FROM ({_cholesky_sql(f'e{_STEPS}')}) WHERE det IS NOT NULL) WHERE rn = 1)",
             f"f AS (SELECT * EXCLUDE (st) FROM e{_STEPS} JOIN b USING (city, st))", f"g AS MATERIALIZED ({_distance_sql('v', 'f', ['city'])})",
             f"h AS (SELECT city, quantile_cont(dist, 0.5) / {_CHI2_MEDIAN} AS sc FROM g GROUP BY city)",
             f"w AS MATERIALIZED ({_scatter_sql('g JOIN h USING (city)', 'city', f'WHERE dist <= sc * {_CHI2_FAR}')})", f"m AS ({_distance_sql('v', 'w', ['city'])})",
             "t AS (SELECT city, quantile_cont(dist, 0.9) AS threshold FROM m GROUP BY city)"]
    return (f"WITH {READINGS_CTE}, {', '.join(ctes)} SELECT city, {i('count(*)', 'n')}, {i('count(*) FILTER (WHERE dist > threshold)', 'outliers')}, "
            f"{d('max(threshold)', 'threshold')}, {d('avg(dist)', 'mean_distance')} FROM m JOIN t USING (city) GROUP BY city")


@register("x4_elliptic_envelope_robust", _robust_sql())
def q_x4r(spark, sf):
    e = X.elliptic_envelope(readings(spark, sf), _ENV, steps=_STEPS)
    return finish(e.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("outliers"),
                                        F.max("threshold").alias("threshold"), F.avg("mahalanobis").alias("mean_distance")))


_JB = ["aqi", "pm2_5", "temperature"]


@register("x5_jarque_bera", f"""WITH {READINGS_CTE},
l AS (UNPIVOT (SELECT city, {', '.join(_JB)} FROM readings) ON {', '.join(_JB)} INTO NAME variable VALUE value),
m AS (SELECT city, variable, avg(value) AS mu FROM l GROUP BY 1, 2),
c AS (SELECT l.city, l.variable, count(*) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3,
             avg(pow(value - mu, 4)) AS m4 FROM l JOIN m USING (city, variable) GROUP BY 1, 2),
k AS (SELECT *, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS ek FROM c),
j AS (SELECT *, n / 6.0 * (skew * skew + ek * ek / 4.0) AS jb FROM k)
SELECT city, variable, {i('n', 'n')}, {d('skew', 'skew')}, {d('ek', 'excess_kurtosis')}, {d('jb', 'jb')},
       {d('exp(-jb / 2)', 'p_value')}, exp(-jb / 2) > 0.05 AS is_normal FROM j""")
def q_x5(spark, sf):
    return finish(X.jarque_bera(readings(spark, sf), _JB))


def _poly_sql(coefficients, x: str) -> str:
    return "(" + " + ".join(f"({c!r}) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


# Algorithms AS 241 (normal quantile) and AS R94 (W test) as published, lowest power first.
_AS241 = {
    "a": (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    "b": (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    "c": (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    "d": (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)}


def _ppf_sql(p: str) -> str:
    """Up to |p - 0.5| = 0.425 and sqrt(-ln p) = 5, which is all that 5,000 values need."""
    tail = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    centre = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_poly_sql(_AS241['a'], centre)} / {_poly_sql(_AS241['b'], centre)} "
            f"ELSE sign({p} - 0.5) * {_poly_sql(_AS241['c'], tail)} / {_poly_sql(_AS241['d'], tail)} END")


_SW = f"""WITH {READINGS_CTE},
l AS (UNPIVOT (SELECT city, {', '.join(_JB)} FROM readings) ON {', '.join(_JB)} INTO NAME variable VALUE value),
s AS (SELECT city, variable, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT l.city, l.variable, value, n, row_number() OVER (PARTITION BY l.city, l.variable ORDER BY value) AS i
      FROM l JOIN s ON l.city IS NOT DISTINCT FROM s.city AND l.variable = s.variable WHERE n BETWEEN 6 AND 5000),
p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM r), q AS (SELECT *, {_ppf_sql('p')} AS m FROM p),
g AS (SELECT city, variable, n, sum(m * m) AS mm, sum(CASE WHEN i > 2 AND i < n - 1 THEN m * value END) AS mid, var_pop(value) * n AS ss,
             max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2, min(value) AS x1, max(value) AS y1,
             max(CASE WHEN i = 2 THEN value END) AS x2, max(CASE WHEN i = n - 1 THEN value END) AS y2, 1 / sqrt(n) AS u FROM q GROUP BY 1, 2, 3),
a AS (SELECT *, {_poly_sql((0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), 'u')} + m1 / sqrt(mm) AS a1,
             {_poly_sql((0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), 'u')} + m2 / sqrt(mm) AS a2 FROM g),
f AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS fac FROM a),
w AS (SELECT city, variable, n, CASE WHEN ss > 0 THEN pow(a1 * (y1 - x1) + a2 * (y2 - x2) + mid / fac, 2) / ss END AS w FROM f),
z AS (SELECT *, CASE WHEN n > 11 THEN (ln(1 - w) - {_poly_sql((-1.5861, -0.31082, -0.083751, 0.0038915), 'ln(n)')}) / exp({_poly_sql((-0.4803, -0.082676, 0.0030302), 'ln(n)')})
             ELSE (-ln({_poly_sql((-2.273, 0.459), 'n')} - ln(1 - w)) - {_poly_sql((0.544, -0.39978, 0.025054, -6.714e-4), 'n')})
                  / exp({_poly_sql((1.3822, -0.77857, 0.062767, -0.0020322), 'n')}) END AS z FROM w)
SELECT s.city, s.variable, {i('s.n', 'n')}, {d('w', 'w')}, {d('z', 'z')}, z < 1.6448536269514722 AS is_normal
FROM s LEFT JOIN z ON s.city IS NOT DISTINCT FROM z.city AND s.variable = z.variable"""


@register("x5_shapiro_wilk", _SW)
def q_x5w(spark, sf):
    """The p-value has no SQL form: left out here, tested against a plain one."""
    return finish(X.shapiro_wilk(readings(spark, sf), _JB).drop("p_value"))


_DF = """SELECT '{c}' AS series, city, {c} - lag({c}) OVER (PARTITION BY city ORDER BY "timestamp") AS dy,
                lag({c}) OVER (PARTITION BY city ORDER BY "timestamp") AS prev FROM hourly"""


@register("x6_dickey_fuller", f"""WITH {HOURLY_CTE},
l AS ({_DF.format(c='aqi')} UNION ALL {_DF.format(c='pm2_5')}),
g AS (SELECT series, city, regr_count(dy, prev) AS n, regr_slope(dy, prev) AS slope, regr_sxx(dy, prev) AS sxx,
             regr_syy(dy, prev) AS syy FROM l GROUP BY series, city),
t AS (SELECT *, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS t_stat FROM g)
SELECT series, city, {i('n', 'n')}, {d('slope', 'slope')}, {d('t_stat', 't_stat')}, t_stat < -2.86 AS is_stationary FROM t""")
def q_x6(spark, sf):
    return finish(X.dickey_fuller(hourly(spark, sf), ["aqi", "pm2_5"]))


@register("x6_augmented_dickey_fuller", None)
def q_x6a(spark, sf):
    """No SQL: least squares in many columns.  Tested against plain least squares for every lag."""
    return finish(X.augmented_dickey_fuller(hourly(spark, sf), ["aqi", "pm2_5"]))


@register("x7_seasonal_decompose", f"""WITH {READINGS_CTE},
dm AS (SELECT city, CAST("timestamp" AS DATE) AS date, avg(aqi) AS aqi_mean FROM readings GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) AS position FROM dm),
t AS (SELECT *, CASE WHEN count(aqi_mean) OVER w = 7 THEN avg(aqi_mean) OVER w END AS trend, (position - 1) % 7 AS phase
      FROM p WINDOW w AS (PARTITION BY city ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
ph AS (SELECT city, phase, avg(aqi_mean - trend) AS pm FROM t GROUP BY 1, 2),
se AS (SELECT city, phase, pm - avg(pm) OVER (PARTITION BY city) AS seasonal FROM ph)
SELECT t.city, {dt('date', 'date')}, {d('aqi_mean', 'aqi_mean')}, {i('position', 'position')}, {i('t.phase', 'phase')},
       {d('trend', 'trend')}, {d('seasonal', 'seasonal')}, {d('aqi_mean - trend - seasonal', 'residual')}
FROM t LEFT JOIN se ON se.city = t.city AND se.phase = t.phase""")
def q_x7(spark, sf):
    dm = A.daily_mean(readings(spark, sf), by=["city"])
    return finish(X.seasonal_decompose(dm, "aqi_mean", 7))


@register("f6_corr_label", f"""WITH {READINGS_CTE}, c AS ({_pairs_sql()})
SELECT city, feature1, feature2, {d('correlation', 'correlation')},
       CASE WHEN abs(correlation) > 0.7 THEN 'Strong' WHEN abs(correlation) > 0.5 THEN 'Moderate'
            WHEN correlation IS NOT NULL THEN 'Weak' END AS strength,
       CASE WHEN correlation > 0 THEN 'Positive' WHEN correlation IS NOT NULL THEN 'Negative' END AS direction FROM c""")
def q_f6(spark, sf):
    from aerolith.functions.scalars import corr_direction, corr_strength
    c = _corr(spark, sf)
    return finish(c.select("city", "feature1", "feature2", "correlation",
                           corr_strength("correlation").alias("strength"),
                           corr_direction("correlation").alias("direction")))
