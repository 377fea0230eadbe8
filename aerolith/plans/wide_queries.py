"""The statistics operators over the wide numeric ``lineitem`` table, grouped by return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import aggregates as A
from aerolith.operators import stats as X
from aerolith.plans.registry import d, finish, i, register
from aerolith.sources.testdata import table

WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
G = "l_returnflag"


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(G, *WIDE)


def _moments_sql(c):
    return (f"{d(f'avg({c})', f'{c}_mean')}, {d(f'stddev_samp({c})', f'{c}_std')}, "
            f"{d(f'skewness({c})', f'{c}_skew')}, {d(f'kurtosis({c})', f'{c}_kurtosis')}")


@register("a5_lineitem_moments", f"""SELECT {G}, {', '.join(_moments_sql(c) for c in WIDE)} FROM lineitem GROUP BY {G}""")
def q_a5l(spark, sf):
    return finish(A.city_moments(_li(spark, sf), WIDE, by=[G]))


_PAIRS = [(a, b) for a in range(len(WIDE)) for b in range(a + 1, len(WIDE))]


def _corr_sql(x, y):
    return (f"CASE WHEN stddev_samp({x}) * stddev_samp({y}) = 0 THEN NULL "
            f"ELSE covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END")


@register("a22_lineitem_corr", " UNION ALL ".join(
    f"SELECT {G}, {i(str(a), 'i')}, {i(str(b), 'j')}, '{WIDE[a]}' AS feature1, '{WIDE[b]}' AS feature2, "
    f"{d(_corr_sql(WIDE[a], WIDE[b]), 'correlation')}, {i('count(*)', 'n')} FROM lineitem GROUP BY {G}"
    for a, b in _PAIRS))
def q_a22l(spark, sf):
    return finish(X.corr_matrix(_li(spark, sf), WIDE, by=[G]))


@register("x1_lineitem_iqr", f"""WITH l AS (UNPIVOT (SELECT {G}, {', '.join(WIDE)} FROM lineitem) ON {', '.join(WIDE)}
                INTO NAME variable VALUE value),
q AS (SELECT {G}, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT q.{G}, q.variable, {d('q1', 'q1')}, {d('q3', 'q3')}, {d('q1 - 1.5 * (q3 - q1)', 'lower')},
       {d('q3 + 1.5 * (q3 - q1)', 'upper')}, {i('count(*)', 'n')},
       {i('count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))', 'outliers')},
       {d('count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*)', 'outlier_percent')}
FROM l JOIN q USING ({G}, variable) GROUP BY q.{G}, q.variable, q1, q3""")
def q_x1l(spark, sf):
    return finish(X.iqr_outliers(_li(spark, sf), WIDE, by=[G]))


@register("x2_lineitem_zscore", f"""WITH st AS (
  SELECT {G}, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in WIDE)} FROM lineitem GROUP BY {G} HAVING count(*) > 10),
z AS (SELECT r.{G}, greatest({', '.join(f'abs(coalesce(CASE WHEN s_{c} = 0 THEN NULL ELSE (r.{c} - m_{c}) / s_{c} END, 0))' for c in WIDE)}) AS mz
      FROM lineitem r JOIN st USING ({G}))
SELECT {G}, {i('count(*)', 'n')}, {i('count(*) FILTER (WHERE mz > 3)', 'anomalies')}, {d('max(mz)', 'max_abs_z')} FROM z GROUP BY {G}""")
def q_x2l(spark, sf):
    z = X.zscore_anomalies(_li(spark, sf), WIDE, by=[G])
    return finish(z.groupBy(G).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"),
                                   F.max("max_abs_z").alias("max_abs_z")))
