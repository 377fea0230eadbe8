"""Radix selection against NumPy: hot groups, copies, far values, null keys; joins of rows with group statistics."""

import struct

import numpy as np
from pyspark.sql import functions as F

from aerolith.functions import util
from aerolith.functions.quantiles import exact_quantiles, quantile_columns, with_sortable_bits
from aerolith.operators import aggregates as A
from aerolith.operators import filters as P
from aerolith.operators import stats as X

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_sortable_bits_are_the_bits_of_the_double(spark):
    rng = np.random.default_rng(0)
    v = [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 1.0, 0.1]
    for e in range(-1074, 1024, 7):
        v += [2.0 ** e, float(np.nextafter(2.0 ** e, 0)), float(np.nextafter(2.0 ** e, np.inf))]
    v += np.frombuffer(rng.integers(0, 0x7FF0 << 48, 3000, dtype=np.int64).tobytes()).tolist()
    df = spark.createDataFrame([(float(x),) for x in v + [-x for x in v]], "v double").select((F.col("v") + 0.0).alias("v"))
    for r in with_sortable_bits(df, "v", "k").collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (bits if r.v > 0 else -bits), r


def test_matches_numpy_linear(spark):
    rng = np.random.default_rng(7)
    groups = {"hot": rng.normal(100, 30, 20000), "dup": np.repeat([1.0, 2.0, 2.0, 3.0], 500), "cold": rng.exponential(5, 37), "one": np.array([4.0]),
              "far": np.append(rng.uniform(0, 1e-3, 5000), [1e300, -1e300]), None: np.array([-0.0, 0.0, -5.0, float("inf")])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["qi"]): r["q"] for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert {g for g, _ in got} == set(groups)
    for g, xs in groups.items():
        with np.errstate(invalid="ignore"):
            want = np.percentile(xs, [100 * p for p in PROBS])
        for k, w in enumerate(want):
            if g is None and k > 3:  # between a finite value and infinity
                continue
            assert abs(got[g, k] - w) <= 1e-9 * max(1.0, abs(w)), (g, PROBS[k], got[g, k], w)


def test_global_group_and_no_values(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as double) v")
    assert exact_quantiles(df, [], "v", [0.5]).first()["q"] == 500.5
    assert exact_quantiles(df.where("v < 0"), [], "v", [0.5]).count() == 0


def test_planning_runs_no_job_and_one_far_value_leaves_small_bins(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 0, 1e250).otherwise(F.hash("id") / 1e6).alias("v"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = quantile_columns(df, ["g"], "v", [0.5], ["m"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    values = np.array([r.v for r in df.collect()])
    assert plan.first()["m"] == np.percentile(values, 50)
    first = with_sortable_bits(df, "v", "k").groupBy(F.shiftright("k", 42)).count().agg(F.max("count")).first()[0]
    assert first < 2_000  # equal-width bins over the range would hold all rows but one


def _without_static_broadcast(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    return keep


def _final_plan(df):
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in p
    return p.split("== Initial Plan ==")[0]


def test_group_statistics_reach_the_rows_without_moving_them(spark):
    rows = [(("a", "b", None)[i % 3 if i % 7 else 0], float(i * 37 % 101), float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "city string, x double, y double").repartition(6)
    plain = {"x1": sorted(map(str, X.iqr_outliers(df, ["x", "y"]).collect())), "x2": sorted(map(str, X.zscore_anomalies(df, ["x", "y"]).collect())),
             "p12": sorted(map(str, P.iqr_outliers_of(df, "x", k=0.1).collect())), "p14": sorted(map(str, P.min_rows_gate(df, ["city"], 900).collect())),
             "a26": sorted(map(str, A.histogram(df, "x", 5, ["city"]).collect()))}
    keep = _without_static_broadcast(spark)
    try:
        made = {"x1": X.iqr_outliers(df, ["x", "y"]), "x2": X.zscore_anomalies(df, ["x", "y"]), "p12": P.iqr_outliers_of(df, "x", k=0.1),
                "p14": P.min_rows_gate(df, ["city"], 900), "a26": A.histogram(df, "x", 5, ["city"])}
        for name, out in made.items():
            plan = _final_plan(out)
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, (name, plan)
            assert sorted(map(str, out.collect())) == plain[name], name
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert any("city=None" in r for r in plain["p12"])


def test_statistics_too_large_to_broadcast_are_salted(spark, monkeypatch):
    monkeypatch.setattr(util, "BROADCAST_BYTES", -1)
    rows = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(500)], "g string, i int").repartition(9)
    stats = rows.groupBy("g").agg(F.sum("i").alias("s"))
    want = sorted(map(str, util.join_null_safe(rows, stats, ["g"]).collect()))
    keep = _without_static_broadcast(spark)
    try:
        for measure in (True, False):
            out = util.attach(rows, stats, ["g"], measure=measure)
            plan = _final_plan(out)
            assert "__salt" in plan and sorted(map(str, out.collect())) == want
        semi = util.attach(rows, stats.where("s > 2000").drop("s"), ["g"], "left_semi")
        assert semi.columns == rows.columns and semi.where("g = 'hot'").count() == rows.where("g = 'hot'").count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
