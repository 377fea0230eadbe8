"""Registered model, metrics and clustering queries.

Model runs and predictions are derived from the tables: the rule forecasts
(F10 / F11) score every hourly row against the value 24 rows later, and one
"run" per (model, city) holds its metrics, stamped with the city's last hour.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions.scalars import rule_forecast
from aerolith.operators import aggregates as A
from aerolith.operators import cluster as C
from aerolith.operators import ml as M
from aerolith.operators import topk as O
from aerolith.operators import joins as J
from aerolith.operators import windows as W
from aerolith.plans.features import training_frame
from aerolith.plans.registry import HOURLY_CTE, NULL_READINGS_CTE, READINGS_CTE, clip_sql, d, finish, i, register, rule_sql, ts
from aerolith.sources.testdata import hourly, readings, readings_with_nulls
from aerolith.sources.store import model_comparison_table

MODELS = {"rule_forecast_a": "a", "rule_forecast_b": "b"}


def rule_predictions(spark, sf):
    t = W.target_ahead(hourly(spark, sf), "aqi", 24)
    parts = [t.select("city", "timestamp", F.lit(m).alias("model"), F.col("aqi_target_24h").alias("label"),
                      rule_forecast(variant=v).alias("prediction")) for m, v in MODELS.items()]
    return parts[0].unionByName(parts[1])


def rule_runs(spark, sf):
    pred = rule_predictions(spark, sf)
    m = A.regression_metrics(pred, by=("model", "city"))
    last = pred.groupBy("city").agg(F.max("timestamp").alias("trained_at"))
    return (m.join(last, "city").select(F.col("model").alias("model_name"), "city", "trained_at",
                                        F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"),
                                        F.col("r2").alias("test_r2"), F.col("n").alias("test_samples")))


_PRED_SQL = f"""{HOURLY_CTE},
t AS (SELECT *, lead(aqi, 24) OVER (PARTITION BY city ORDER BY "timestamp") AS label FROM hourly),
pred AS (SELECT city, "timestamp", 'rule_forecast_a' AS model, label, {clip_sql(rule_sql('a'))} AS prediction FROM t WHERE label IS NOT NULL
         UNION ALL
         SELECT city, "timestamp", 'rule_forecast_b', label, {clip_sql(rule_sql('b'))} FROM t WHERE label IS NOT NULL),
met AS (SELECT model, city, count(*) AS n, avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
               1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) AS r2 FROM pred GROUP BY 1, 2),
runs AS (SELECT model AS model_name, met.city, l.trained_at, mae AS test_mae, rmse AS test_rmse, r2 AS test_r2, n AS test_samples
         FROM met JOIN (SELECT city, max("timestamp") AS trained_at FROM pred GROUP BY city) l USING (city))"""

_RUN_SEL = f"""model_name, city, {ts('trained_at', 'trained_at')}, {d('test_mae', 'test_mae')}, {d('test_rmse', 'test_rmse')},
       {d('test_r2', 'test_r2')}, {i('test_samples', 'test_samples')}"""


@register("a28_regression_metrics", f"""WITH {_PRED_SQL}
SELECT model, city, {i('n', 'n')}, {d('mae', 'mae')}, {d('rmse', 'rmse')}, {d('r2', 'r2')} FROM met""")
def q_a28(spark, sf):
    return finish(A.regression_metrics(rule_predictions(spark, sf), by=("model", "city")))


@register("a20_ensemble_mean", f"""WITH {_PRED_SQL}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('avg(prediction)', 'ensemble')}, {i('count(prediction)', 'n_models')},
       {d('min(prediction)', 'pred_min')}, {d('max(prediction)', 'pred_max')} FROM pred GROUP BY city, "timestamp\"""")
def q_a20(spark, sf):
    return finish(A.ensemble_mean(rule_predictions(spark, sf), ["city", "timestamp"]))


@register("o6_latest_artifact", f"""WITH {_PRED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY trained_at DESC, city DESC) AS rn FROM runs)
SELECT {_RUN_SEL} FROM r WHERE rn = 1""")
def q_o6(spark, sf):
    runs = rule_runs(spark, sf).select("model_name", "trained_at", "city", "test_mae", "test_rmse", "test_r2",
                                       "test_samples")
    return finish(O.latest_artifact(runs, ("model_name",), "trained_at"))


@register("o7_best_model", f"""WITH {_PRED_SQL}
SELECT arg_min(model_name || '@' || city, (CASE WHEN test_r2 IS NULL THEN 1 ELSE 0 END, -test_r2, model_name || '@' || city)) AS best_run
FROM runs""")
def q_o7(spark, sf):
    runs = rule_runs(spark, sf).withColumn("run", F.concat_ws("@", "model_name", "city"))
    return finish(O.arg_best(runs, "run", "test_r2", name="best_run"))


@register("o9_prediction_sample", f"""WITH {_PRED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY city, "timestamp") AS rank FROM pred)
SELECT model, city, {ts('"timestamp"', '"timestamp"')}, {d('label', 'label')}, {d('prediction', 'prediction')}, {i('rank', 'rank')}
FROM r WHERE rank <= 10""")
def q_o9(spark, sf):
    return finish(O.top_k_per_group(rule_predictions(spark, sf), ["model"], ["city", "timestamp"], 10))


@register("m9_needs_training", f"""WITH {_PRED_SQL}, {READINGS_CTE.replace('readings AS (', 'rd AS (', 1)}
SELECT model_name, {ts('max(trained_at)', 'latest_run')},
       count(*) FILTER (WHERE trained_at > (SELECT max("timestamp") FROM rd) - INTERVAL 24 HOUR) = 0 AS needs_training
FROM runs GROUP BY model_name""")
def q_m9(spark, sf):
    as_of = readings(spark, sf).agg(F.max("timestamp")).scalar()
    return finish(M.needs_training(rule_runs(spark, sf), as_of, by=["model_name"]))


@register("m11_r2_drop_gate", f"""WITH {_PRED_SQL},
g AS (SELECT *, lag(test_r2) OVER (PARTITION BY model_name ORDER BY trained_at, city) AS prev_r2 FROM runs)
SELECT {_RUN_SEL}, {d('prev_r2', 'prev_r2')},
       {d('CASE WHEN abs(prev_r2) = 0 THEN NULL ELSE (prev_r2 - test_r2) / abs(prev_r2) END', 'relative_drop')},
       coalesce(CASE WHEN abs(prev_r2) = 0 THEN NULL ELSE (prev_r2 - test_r2) / abs(prev_r2) END > 0.05, false) AS retrain FROM g""")
def q_m11(spark, sf):
    runs = rule_runs(spark, sf)
    return finish(M.r2_drop_gate(runs, ts="trained_at", tie=["city"]).select(
        "model_name", "city", "trained_at", "test_mae", "test_rmse", "test_r2", "test_samples", "prev_r2",
        "relative_drop", "retrain"))


@register("s9_model_comparison_table", f"""WITH {_PRED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY trained_at DESC, city DESC) AS rn FROM runs)
SELECT replace(model_name, '_', ' ') AS m0, printf('%.3f', test_mae) AS "MAE", printf('%.3f', test_rmse) AS "RMSE",
       printf('%.3f', test_r2) AS "R2" FROM r WHERE rn = 1""".replace(
    "replace(model_name, '_', ' ') AS m0",
    "CASE model_name WHEN 'rule_forecast_a' THEN 'Rule Forecast A' WHEN 'rule_forecast_b' THEN 'Rule Forecast B' END AS \"Model\""))
def q_s9(spark, sf):
    runs = rule_runs(spark, sf).select("model_name", "trained_at", "city", "test_mae", "test_rmse", "test_r2")
    return finish(model_comparison_table(O.latest_artifact(runs, ("model_name",), "trained_at")))


@register("j6_predictions_with_metrics", f"""WITH {_PRED_SQL},
last AS (SELECT model, city, arg_max(prediction, "timestamp") AS prediction FROM pred GROUP BY 1, 2)
SELECT last.model, last.city, {d('prediction', 'prediction')},
       CASE WHEN prediction BETWEEN 0 AND 50 THEN 'Good' WHEN prediction BETWEEN 51 AND 100 THEN 'Moderate'
            WHEN prediction BETWEEN 101 AND 150 THEN 'Unhealthy for Sensitive Groups' WHEN prediction BETWEEN 151 AND 200 THEN 'Unhealthy'
            WHEN prediction BETWEEN 201 AND 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category,
       {d('test_mae', 'test_mae')}, {d('test_r2', 'test_r2')}, 'Rule-based' AS method
FROM last LEFT JOIN runs ON runs.model_name = last.model AND runs.city = last.city""")
def q_j6(spark, sf):
    from aerolith.operators.joins import predictions_with_metrics
    pred = rule_predictions(spark, sf)
    last = pred.groupBy("model", "city").agg(F.max_by("prediction", "timestamp").alias("prediction"))
    met = rule_runs(spark, sf).select(F.col("model_name").alias("model"), "city", "test_mae", "test_r2")
    out = predictions_with_metrics(last, met, ["model", "city"]).withColumn("method", F.lit("Rule-based"))
    out = J.category_by_range(out, "prediction", prefix="__").withColumnRenamed("__category", "category")
    return finish(out.drop("__color", "__css_class", "__description"))


@register("m13_multi_horizon", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')},
       {', '.join(d(f'lead(aqi, {h}) OVER (PARTITION BY city ORDER BY "timestamp")', f'aqi_target_{h}h') for h in (24, 48, 72))}
FROM hourly""")
def q_m13(spark, sf):
    h = hourly(spark, sf).select("city", "timestamp", "aqi")
    return finish(W.multi_horizon_targets(h))


@register("m1_scale_features", f"""WITH {HOURLY_CTE},
st AS (SELECT avg(aqi) AS ma, stddev_pop(aqi) AS sa, avg(temperature) AS mt, stddev_pop(temperature) AS st_,
              avg(humidity) AS mh, stddev_pop(humidity) AS sh FROM hourly)
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('coalesce(CASE WHEN sa = 0 THEN NULL ELSE (aqi - ma) / sa END, 0)', 'aqi_z')},
       {d('coalesce(CASE WHEN st_ = 0 THEN NULL ELSE (temperature - mt) / st_ END, 0)', 'temperature_z')},
       {d('coalesce(CASE WHEN sh = 0 THEN NULL ELSE (humidity - mh) / sh END, 0)', 'humidity_z')} FROM hourly, st""")
def q_m1(spark, sf):
    h = hourly(spark, sf)
    z = M.scale_features(h, ["aqi", "temperature", "humidity"], suffix="_z")
    return finish(z.select("city", "timestamp", "aqi_z", "temperature_z", "humidity_z"))


# --- rows-only: model training, scoring, clustering -------------------------------------------------------------

FEATURES = ["temperature", "humidity", "pressure", "wind_speed", "pm2_5", "pm10", "no2", "o3", "hour", "day_of_week",
            "month", "hour_sin", "hour_cos", "aqi_lag_1h", "aqi_lag_24h", "pm25_lag_1h", "temp_lag_1h"]


def _train(spark, sf, only=None):
    """Fit on the training frame with the operators' own sizes; rows whose 24-row target reaches
    into the test rows are left out of training."""
    tf = training_frame(hourly(spark, sf)).checkpoint(eager=True)
    split = W.chronological_split(tf)
    start = split.filter(F.col("is_test")).groupBy("city").agg(F.min("timestamp").alias("__test_from"))
    train = (split.filter(~F.col("is_test")).join(F.broadcast(start), "city", "left")
             .filter(F.coalesce(F.col("timestamp") < F.col("__test_from") - F.expr("INTERVAL 24 HOURS"), F.lit(True))).drop("__test_from"))
    test = split.filter(F.col("is_test"))
    models = {k: v for k, v in M.estimators("aqi_target_24h").items() if only is None or k in only}
    return M.train_all(train, test, FEATURES, "aqi_target_24h", ["city", "timestamp"], models=models), tf


@register("m6_train_all")
def q_m6(spark, sf):
    (fitted, long, metrics), _ = _train(spark, sf)
    return finish(metrics)


@register("m7_score_batch")
def q_m7(spark, sf):
    (fitted, long, metrics), tf = _train(spark, sf)
    return finish(M.score_batch(fitted, tf, ["city", "timestamp"]))


@register("m8_predict_with_ensemble")
def q_m8(spark, sf):
    (fitted, long, metrics), tf = _train(spark, sf)
    key = ["city", "timestamp"]
    found = M.ensemble(M.score_batch(fitted, tf, key), key)
    return finish(M.with_rule_fallback(found, hourly(spark, sf), key))


@register("m8_rule_fallback", f"""WITH {NULL_READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('CASE WHEN aqi IS NOT NULL THEN round_even(greatest(20.0, least(500.0, aqi)), 1) ELSE round_even(' + clip_sql(rule_sql()) + ', 1) END', 'ensemble')},
       CASE WHEN aqi IS NOT NULL THEN 'models' ELSE 'rule' END AS source FROM nreadings""")
def q_m8_fallback(spark, sf):
    """Readings with nulls: a model that repeats the measured value gives nothing where it is null."""
    rows = readings_with_nulls(spark, sf).withColumn("__id", F.monotonically_increasing_id())
    key = ["city", "timestamp", "__id"]
    rows = rows.checkpoint(eager=True)
    naive = rows.filter(F.col("aqi").isNotNull()).select(*key, F.lit("naive").alias("model"), F.greatest(F.lit(20.0), F.least(F.lit(500.0), "aqi")).alias("prediction"))
    return finish(M.with_rule_fallback(M.ensemble(naive, key), rows, key).select("city", "timestamp", "ensemble", "source"))


_U = """CAST(('0x' || substr(md5(concat_ws('|', city, CAST("timestamp" AS VARCHAR), '42')), 1, 7)) AS BIGINT) / 268435456.0"""


@register("m5_hash_split", f"""WITH {HOURLY_CTE}, s AS (SELECT *, CASE WHEN {_U} < 0.8 THEN 'train' ELSE 'test' END AS split FROM hourly)
SELECT split, {i('count(*)', '"rows"')}, {d('avg(aqi)', 'mean_aqi')} FROM s GROUP BY split""")
def q_m5(spark, sf):
    h = M.hash_split(hourly(spark, sf).select("city", "timestamp", "aqi"), ["city", "timestamp"])
    return finish(h.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg("aqi").alias("mean_aqi")))


@register("m14_three_way_split", f"""WITH {HOURLY_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')}, CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.8 THEN 'validation' ELSE 'test' END AS split FROM hourly""")
def q_m14(spark, sf):
    h = M.hash_split(hourly(spark, sf).select("city", "timestamp"), ["city", "timestamp"], (0.7, 0.1, 0.2),
                     ("train", "validation", "test"))
    return finish(h)


_KC = ["aqi", "pm2_5", "temperature", "humidity", "no2"]


@register("x8_kmeans_auto_k")
def q_x8(spark, sf):
    k, labelled, elbow = C.kmeans_auto_k(hourly(spark, sf), _KC)
    return finish(labelled.select("city", "timestamp", "cluster"))


@register("x9_elbow_curve")
def q_x9(spark, sf):
    k, labelled, elbow = C.kmeans_auto_k(hourly(spark, sf), _KC)
    return finish(elbow)


@register("a27_cluster_profile")
def q_a27(spark, sf):
    k, labelled, elbow = C.kmeans_auto_k(hourly(spark, sf), _KC)
    return finish(A.cluster_profile(labelled, _KC))


@register("x10_pca2")
def q_x10(spark, sf):
    scored, ev = C.pca2(hourly(spark, sf), _KC)
    return finish(scored.select("city", "timestamp", "pc1", "pc2"))


@register("x3_isolation_forest")
def q_x3(spark, sf):
    out = C.isolation_forest(readings(spark, sf),
                             ["aqi", "pm2_5", "temperature", "humidity"], key=["city", "timestamp"])
    return finish(out.select("city", "timestamp", "anomaly_score", "is_anomaly"))


@register("x12_eda_report")
def q_x12(spark, sf):
    from aerolith.plans.report import eda_report
    return eda_report(readings(spark, sf))


@register("m12_feature_importance")
def q_m12(spark, sf):
    (fitted, long, metrics), _ = _train(spark, sf, ("random_forest", "gradient_boosting"))
    return finish(M.feature_importance(fitted, FEATURES))


@register("s8_read_nested_metrics", f"""WITH {_PRED_SQL}
SELECT model_name, {', '.join(f'CAST(NULL AS DOUBLE) AS train_{m}' for m in ('mae', 'rmse', 'r2'))},
       {d('test_mae', 'test_mae')}, {d('test_rmse', 'test_rmse')}, {d('test_r2', 'test_r2')}, CAST(NULL AS VARCHAR) AS error FROM runs""")
def q_s8(spark, sf):
    """Write the per-model metrics of the rule forecasts as one nested document per run
    ({model: {metric: value}}), then read the documents back into long rows."""
    from aerolith.session import scratch_path
    from aerolith.sources.store import read_nested_metrics
    import uuid
    runs = rule_runs(spark, sf)
    doc = runs.groupBy("city").agg(*[
        F.max(F.when(F.col("model_name") == m, F.struct("test_mae", "test_rmse", "test_r2"))).alias(m) for m in MODELS])
    path = scratch_path(spark, f"s8-{uuid.uuid4().hex[:12]}")
    doc.drop("city").write.mode("overwrite").json(path)
    return finish(read_nested_metrics(spark, path, multi_line=False).drop("source"))


@register("a19_prediction_range", f"""WITH {_PRED_SQL},
last AS (SELECT model, city, arg_max(prediction, "timestamp") AS prediction FROM pred GROUP BY 1, 2)
SELECT city, {d('min(prediction)', 'pred_min')}, {d('max(prediction)', 'pred_max')}, {i('count(prediction)', 'n_models')}
FROM last GROUP BY city""")
def q_a19(spark, sf):
    pred = rule_predictions(spark, sf)
    last = pred.groupBy("model", "city").agg(F.max_by("prediction", "timestamp").alias("prediction"))
    return finish(last.groupBy("city").agg(F.min("prediction").alias("pred_min"), F.max("prediction").alias("pred_max"),
                                           F.count("prediction").alias("n_models")))


@register("s10_save_load_model")
def q_s10(spark, sf):
    """Fit a linear model on the training frame, save it with ML persistence, log the run
    (S8 writer) and score the whole frame with the newest artefact loaded back (S10 / O6)."""
    import datetime as dt
    import uuid
    from aerolith.session import scratch_path
    from aerolith.sources.store import load_latest_model, log_metrics, read_metrics, save_model
    (fitted, long, metrics), tf = _train(spark, sf, ("linear_regression",))
    base = scratch_path(spark, f"s10-{uuid.uuid4().hex[:12]}")
    model_path = f"{base}/linear_regression"
    save_model(fitted["linear_regression"], model_path)
    runs = (metrics.filter(F.col("split") == "test")
                   .select(F.col("model").alias("model_name"), F.col("mae").alias("test_mae"),
                           F.col("rmse").alias("test_rmse"), F.col("r2").alias("test_r2"),
                           F.lit(model_path).alias("model_path"),
                           F.lit(dt.datetime.now()).cast("timestamp_ntz").alias("trained_at")))
    log_metrics(runs, f"{base}/model_runs")
    model = load_latest_model(spark, read_metrics(spark, f"{base}/model_runs"), "linear_regression")
    return finish(model.transform(tf).select("city", "timestamp", "aqi_target_24h", "prediction"))
