"""Sinks and artefacts: partition overwrite, report document, metrics documents, model save/load."""

import json
import os
import uuid

from pyspark.sql import functions as F

from aerolith.session import scratch_path
from aerolith.sources import store
from aerolith.sources.testdata import readings
from tests.conftest import SF001


def _local(p):
    return p.replace("file:", "")


def test_write_readings_is_idempotent_and_partition_scoped(spark):
    path = scratch_path(spark, f"s2-{uuid.uuid4().hex[:8]}")
    rd = readings(spark, SF001).select("city", "timestamp", "aqi")
    store.write_readings(rd, path)
    store.write_readings(rd, path)
    back = store.read_readings(spark, path)
    assert back.count() == rd.count()
    # rewriting one city's rows touches only that city's partitions
    one = rd.filter(F.col("city") == "click").withColumn("aqi", F.lit(1.0))
    store.write_readings(one, path)
    back = store.read_readings(spark, path)
    assert back.count() == rd.count()
    assert back.filter(F.col("city") == "click").agg(F.max("aqi")).first()[0] == 1.0
    assert back.filter(F.col("city") != "click").agg(F.max("aqi")).first()[0] > 1.0


def test_csv_read_casts_timestamp(spark):
    path = scratch_path(spark, f"s1-{uuid.uuid4().hex[:8]}")
    rd = readings(spark, SF001).select("timestamp", "city", "temperature", "humidity", "aqi", "pm2_5")
    rd.write.option("header", True).csv(path)
    back = store.read_readings(spark, path, fmt="csv")
    assert dict(back.dtypes)["timestamp"] == "timestamp_ntz"
    assert back.count() == rd.count()


def test_nested_metrics_document(spark, tmp_path):
    doc = {"linear_regression": {"train_mae": 1.0, "train_rmse": 2.0, "train_r2": 0.3, "test_mae": 4.0,
                                 "test_rmse": 5.0, "test_r2": 0.6},
           "xgboost": {"error": "not installed"}}
    p = tmp_path / "performance.json"
    p.write_text(json.dumps(doc, indent=2))
    rows = {r["model_name"]: r for r in store.read_nested_metrics(spark, str(tmp_path)).collect()}
    assert rows["linear_regression"]["test_r2"] == 0.6 and rows["linear_regression"]["error"] is None
    assert rows["xgboost"]["error"] == "not installed" and rows["xgboost"]["test_mae"] is None


def test_model_save_load_roundtrip(spark):
    from pyspark.ml import PipelineModel
    from aerolith.operators import ml as M
    from aerolith.sources.testdata import hourly
    h = hourly(spark, SF001)
    train = h.select("temperature", "humidity", "pm2_5", F.col("aqi").alias("y"))
    fitted, long, metrics = M.train_all(train, train, ["temperature", "humidity", "pm2_5"], "y", ["temperature"],
                                        models={"linear_regression": M.estimators("y")["linear_regression"]})
    path = scratch_path(spark, f"s10-{uuid.uuid4().hex[:8]}")
    store.save_model(fitted["linear_regression"], path)
    again = PipelineModel.load(path)
    a = fitted["linear_regression"].transform(train).select("prediction").collect()
    b = again.transform(train).select("prediction").collect()
    assert a == b


def test_report_written_as_one_document(spark):
    from aerolith.plans.report import write_eda_report
    path = scratch_path(spark, f"s7-{uuid.uuid4().hex[:8]}")
    write_eda_report(readings(spark, SF001), path)
    files = [f for f in os.listdir(_local(path)) if f.endswith(".json")]
    assert len(files) == 1
    doc = json.loads(open(os.path.join(_local(path), files[0])).readline())
    assert doc["overview"]["cities"] == 5 and len(doc["aqi_categories"]) >= 1


def test_delete_from_store_rewrites_only_touched_partitions(spark):
    path = scratch_path(spark, f"s4-{uuid.uuid4().hex[:8]}")
    rd = readings(spark, SF001).select("city", "timestamp", "aqi")
    store.write_readings(rd, path)
    before = store.read_readings(spark, path)
    n_before = before.count()
    n_click = before.filter(F.col("city") == "click").count()
    n_big = before.filter((F.col("city") == "view") & (F.col("aqi") > 100)).count()
    # whole city: its partitions disappear
    assert store.delete_from_store(spark, path, F.col("city") == "click") == n_click
    # some rows of another city; a NULL predicate keeps the row
    pred = (F.col("city") == "view") & (F.when(F.col("aqi") > 100, True))
    assert store.delete_from_store(spark, path, pred) == n_big
    after = store.read_readings(spark, path)
    assert after.count() == n_before - n_click - n_big
    assert after.filter(F.col("city") == "click").count() == 0
    assert not any(p.startswith("city=click") for p in os.listdir(_local(path)))
