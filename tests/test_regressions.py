"""One small case for each fault that let rows or values go wrong."""

import datetime as dt
import shutil
import uuid

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerolith.operators import cluster as C
from aerolith.operators import ml as M
from aerolith.session import scratch_path
from aerolith.sources import store as S
from aerolith.streaming import streams as T


def fresh(spark, name):
    return T.fresh_dirs(spark, name)[0]


def test_csv_columns_are_taken_by_name(spark):
    path = fresh(spark, "csv")
    spark.createDataFrame([("2024-01-01 05:00:00", "21.5", "60", "85", "12.5"), ("2024-01-01 06:00:00", "NaN", "61", None, "13")],
                          "timestamp string, temperature string, humidity string, aqi string, pm2_5 string").coalesce(1).write.option("header", True).csv(path)
    rows = S.read_readings(spark, path, "csv").orderBy("timestamp").collect()
    assert [(r.timestamp, r.temperature, r.humidity, r.aqi, r.pm2_5, r.city) for r in rows] == [
        (dt.datetime(2024, 1, 1, 5), 21.5, 60.0, 85.0, 12.5, None), (dt.datetime(2024, 1, 1, 6), None, 61.0, None, 13.0, None)]


def test_delete_reaches_null_and_escaped_partitions(spark):
    path = fresh(spark, "delete")
    rows = [(c, dt.datetime(2024, 1, 1, h), float(a)) for c, h, a in [(None, 1, 1), (None, 2, 9), ("a:b", 1, 2), ("x", 1, 3), ("x", 2, 8), ("y/z", 3, 9)]]
    S.write_readings(spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double"), path)
    assert S.delete_from_store(spark, path, F.col("aqi") < 5) == 3
    left = spark.read.parquet(path).collect()
    assert sorted((str(r.city), r.aqi) for r in left) == [("None", 9.0), ("x", 8.0), ("y/z", 9.0)]
    assert S.delete_from_store(spark, path, F.col("aqi") < 5) == 0


def _ingest(spark, batches):
    src, out = fresh(spark, "ingest-in"), fresh(spark, "ingest-out")
    schema = "city string, timestamp timestamp_ntz, aqi double, arrival long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/part=*")
        T.stream_ingest_upsert(stream, out, ["city", "timestamp"], out + "-chk", ordinal="arrival")
    return sorted((str(r.city), r.timestamp.hour, r.aqi) for r in spark.read.parquet(out).collect())


def test_ingest_dedupes_the_first_batch_and_keeps_stored_rows(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    got = _ingest(spark, [[("a", at(1), 1.0, 1), ("a", at(1), 2.0, 2), (None, at(1), 5.0, 3), (None, at(2), 6.0, 4)],
                          [("a", at(2), 3.0, 5), ("a", at(1), 4.0, 6), (None, at(1), 7.0, 7)]])
    assert got == [("None", 1, 7.0), ("None", 2, 6.0), ("a", 1, 4.0), ("a", 2, 3.0)]


def test_lost_stream_state_is_an_error(spark):
    src, (out, chk) = scratch_path(spark, f"lost-{uuid.uuid4().hex[:8]}"), T.fresh_dirs(spark, "lost")

    def more(minute):
        rows = [("a", dt.datetime(2024, 1, 1, 0, minute))]
        spark.createDataFrame(rows, "city string, timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = T.event_stream(spark, src, spark.read.parquet(src).schema).withColumn("event_time", T.event_time("timestamp"))
        T.run_to_parquet(T.stream_freshness(stream), out, chk)
    more(1)
    run()
    more(2)
    shutil.move(f"{chk.removeprefix('file:')}/state", f"{chk.removeprefix('file:')}-lost-state")
    with pytest.raises(Exception, match="(?i)state"):
        run()


def frame(spark, n=60):
    rows = [(i, float(i), None if i % 5 == 0 else float(i % 7), 2.0 * i + 1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def test_null_features_are_imputed_not_dropped(spark):
    df = frame(spark)
    fitted, long, metrics = M.train_all(df.filter("id < 40"), df.filter("id >= 40"), ["a", "b"], "y", ["id"], models={"linear_regression": LinearRegression(labelCol="y")})
    assert long.count() == 60
    scored = M.score_batch(fitted, df, ["id"])
    assert scored.count() == 60 and scored.filter("prediction IS NULL").count() == 0
    mean = np.mean([i % 7 for i in range(40) if i % 5])
    model = fitted["linear_regression"].stages[-1]
    want = model.intercept + model.coefficients[0] * 50 + model.coefficients[1] * mean
    assert abs(fitted["linear_regression"].transform(df.filter("id = 50")).first().prediction - want) < 1e-9


def test_training_reports_when_every_model_fails(spark):
    class Broken(LinearRegression):
        def _fit(self, dataset):
            raise ValueError("cannot be fitted")
    df = frame(spark)
    fitted, long, metrics = M.train_all(df, df, ["a"], "y", ["id"], models={"one": Broken(labelCol="y"), "two": Broken(labelCol="y")})
    assert fitted == {} and long.count() == 0
    assert sorted((r.model, "cannot be fitted" in r.error) for r in metrics.collect()) == [("one", True), ("two", True)]


def test_path_length_of_small_leaves():
    assert [C._c(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert abs(C._c(3) - (2 * (np.log(2) + 0.5772156649) - 4 / 3)) < 1e-12
    nodes = [(0, 5.0, 1, 2, 4.0), (-1, 0.0, -1, -1, 2.0), (-1, 0.0, -1, -1, 1.0)]  # two rows left, one right
    assert C._path_lengths(np.array([[1.0], [9.0]]), C._arrays(nodes)).tolist() == [2.0, 1.0]


def test_a_tree_receives_about_twice_its_sample(spark):
    n, trees, sample = 4000, 20, 32
    df = spark.range(n).select(F.lit("a").alias("city"), F.col("id"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    candidates = C.tree_candidates(df, df.groupBy("city").agg(F.count(F.lit(1)).alias("__n")), ["city"], ["v"], ["id"], trees, sample, 42)
    sizes = [r["count"] for r in candidates.groupBy("city", "tree").count().collect()]
    assert len(sizes) == trees and sample <= min(sizes) and max(sizes) <= 3 * sample
    assert C.isolation_forest(df, ["v"], ["id"], n_trees=trees, sample_size=sample).count() == n


def test_no_model_leaves_every_row_to_the_rule(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8), 50.0)], "id long, timestamp timestamp_ntz, aqi double")
    none = M.score_batch({}, df, ["id"])
    assert none.columns == M.score_batch({"m": _Constant()}, df, ["id"]).columns and none.count() == 0
    assert M.ensemble(none, ["id"]).count() == 0


class _Constant:
    def transform(self, df):
        return df.withColumn("prediction", F.lit(7.0))


def test_a_wanted_model_without_a_run_needs_training(spark):
    runs = spark.createDataFrame([("old", dt.datetime(2024, 1, 1)), ("new", dt.datetime(2024, 1, 9))], "model_name string, trained_at timestamp_ntz")
    got = M.needs_training(runs, F.lit(dt.datetime(2024, 1, 9, 1)).cast("timestamp_ntz"), by=["model_name"], models=["new", "never", "old", "never"])
    assert {r.model_name: r.needs_training for r in got.collect()} == {"new": False, "never": True, "old": True} and got.count() == 3


def test_a_bad_csv_cell_is_null(spark):
    path = fresh(spark, "csv")
    spark.createDataFrame([("x",)], "v string").selectExpr("'a' AS city", "'2024-01-01 00:00:00' AS timestamp", "'n/a' AS aqi", "'3.5' AS pm2_5").write.option("header", True).csv(path)
    row = S.read_readings(spark, path, "csv").first()
    assert row.aqi is None and row.pm2_5 == 3.5 and row.city == "a"


def test_hour_frames_run_on_running_aggregates_only(spark):
    from aerolith.operators.windows import time_rolling_stats
    start = dt.datetime(1969, 12, 31, 20)
    rows = [("a" if k % 3 else None, start + dt.timedelta(minutes=20 * (k // 2)), None if k % 11 == 0 else (k * 37 % 500) / 4) for k in range(240)]
    rows += [("a", None, 1.0), ("a", None, 3.0), ("a", start + dt.timedelta(hours=9), 7.0)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double")
    for kw in ({"scale": 100}, {}):
        out = time_rolling_stats(df, "aqi", (3, 24), **kw)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedpreceding" in plan.lower() and "INTERVAL '-" not in plan and "-INTERVAL" not in plan  # a sliding frame costs rows times frame
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            for h in (3, 24):
                own = [v for c, t, v in rows if c == r.city and v is not None and
                       (t is None if r.timestamp is None else t is not None and r.timestamp - dt.timedelta(hours=h) <= t <= r.timestamp)]
                assert r[f"aqi_troll_n_{h}h"] == len(own)
                assert (r[f"aqi_troll_min_{h}h"], r[f"aqi_troll_max_{h}h"]) == ((min(own), max(own)) if own else (None, None))
                assert r[f"aqi_troll_mean_{h}h"] == (pytest.approx(np.mean(own)) if own else None)
                assert r[f"aqi_troll_std_{h}h"] == (pytest.approx(np.std(own, ddof=1), abs=1e-9) if len(own) > 1 else None)


def test_envelope_distance_is_computed_once_a_row(spark):
    from aerolith.operators import stats as X
    rows = spark.createDataFrame([("a", float(k), float(k * k % 17)) for k in range(40)], "city string, x double, y double")
    est = X._location_scatter(rows, ["city"], ["x", "y"]).checkpoint(eager=True)
    far = X._with_distance(rows, est, ["city"], ["x", "y"], "dist").where(F.col("dist").isNotNull() & ~F.isnan("dist") & (F.col("dist") > 1))
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__inv#") - plan.count("AS __inv#") < 12  # a filter pushed below it repeats its three products per mention
    data = np.array([(r.x, r.y) for r in rows.collect()])
    centred, inverse = data - data.mean(0), np.linalg.inv(np.cov(data.T, bias=True))
    want = np.einsum("ij,jk,ik->i", centred, inverse, centred)
    assert sorted(r.dist for r in far.collect()) == pytest.approx(sorted(want[want > 1]))
