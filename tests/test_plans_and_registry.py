"""Registry consistency, plan shape, and a sample of oracle comparisons on sf0.001."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "aqi_category" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_python_udf(spark):
    p = _plan(E.queries()["flagship_city_category_profile"](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filter_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from aerolith.sources.testdata import readings
    df = readings(spark, SF001).filter(F.col("city") == "click").select("city", "aqi")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    assert "ReadSchema: struct<event_type:string,value:double>" in p


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def _canon(df):
    df = df[sorted(df.columns)].astype(object).map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["a4_city_summary5", "w1_lags", "j2b_upsert_columns", "x7_seasonal_decompose",
                                  "a25_boxplot_stats", "w10_training_frame", "t2_stream_hourly_mean"])
def test_oracle_sample_sf0001(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    a = _canon(E.queries()[name](spark, SF001).toPandas())
    b = _canon(con.execute(E.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def _final_plan(df):
    """The plan that ran: the frame itself is collected, then its own plan is read."""
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in p
    return p.split("== Initial Plan ==")[0]


def test_category_lookups_compile_to_expressions(spark):
    for name in ("j4_category_by_code", "j7_pm25_to_aqi", "f4_category_by_threshold"):
        p = _plan(E.queries()[name](spark, SF001))
        assert "Join" not in p, name


def test_keep_last_is_an_aggregate_not_a_window(spark):
    p = _final_plan(E.queries()["w6_dedupe_keep_last"](spark, SF001))
    assert "max_by" in p and "Window" not in p


def test_upsert_columns_is_one_outer_join(spark):
    p = _final_plan(E.queries()["j2b_upsert_columns"](spark, SF001))
    assert p.count("FullOuter") == 1


def test_series_windows_are_chunked(spark):
    p = _final_plan(E.queries()["w1_lags"](spark, SF001))
    # the lag window is partitioned by (city, chunk), never by city alone
    assert "windowspecdefinition(city" in p
    for line in p.splitlines():
        if "Window [lag(" in line:
            assert "__ch" in line


def test_correlation_matrix_is_one_aggregate(spark):
    p = _final_plan(E.queries()["a22_corr_matrix"](spark, SF001))
    assert p.count("HashAggregate(keys=[city") + p.count("ObjectHashAggregate(keys=[city") >= 1
    assert "Join" not in p


def test_profiles_are_ordered(spark):
    from aerolith.operators import aggregates as A
    from aerolith.operators import stats as X
    from aerolith.sources.testdata import readings, readings_with_nulls
    rd, nulls = readings(spark, SF001), readings_with_nulls(spark, SF001)
    counts = [r["count"] for r in A.category_distribution(rd).collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) > 1
    shares = [r["missing_percent"] for r in A.null_profile(nulls).collect()]
    assert shares == sorted(shares, reverse=True) and len(shares) > 1
    rows = X.corr_with_target(rd, ["aqi", "pm2_5", "temperature", "humidity", "o3"]).collect()
    for t in ("aqi", "pm2_5"):
        r = [x.abs_correlation for x in rows if x.target == t]
        assert r == sorted(r, reverse=True) and len(r) == 4
