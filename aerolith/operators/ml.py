"""Model training, scoring and gates (M1-M14) on Spark ML.

Training is distributed by MLlib; metrics are aggregates over a long
prediction table (A28), so nothing is collected per row on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.scalars import clip, round_half_even, rule_forecast
from aerolith.operators.joins import category_by_range
from aerolith.operators.aggregates import regression_metrics


def scale_features(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   suffix: str = "") -> DataFrame:
    """M1: z-scaling with the *population* std of ``fit_on`` (the training rows); constant -> 0."""
    src = fit_on if fit_on is not None else df
    st = src.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                          *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.try_divide(F.col(c) - st[f"m_{c}"], st[f"s_{c}"]), F.lit(0.0))
                           for c in cols})


def hash_split(df: DataFrame, key: Sequence[str], fractions: Sequence[float] = (0.8, 0.2),
               names: Sequence[str] = ("train", "test"), seed: int = 42, col: str = "split") -> DataFrame:
    """Stable split by key hash (independent of partitioning, retries and engine): the first
    seven hex digits of the MD5 of the key columns and the seed as text, joined by ``|``."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(16 ** 7))
    e, acc = None, 0.0
    for f, n in zip(fractions[:-1], names[:-1]):
        acc += f
        e = F.when(u < acc, n) if e is None else e.when(u < acc, n)
    return df.withColumn(col, e.otherwise(names[-1]) if e is not None else F.lit(names[-1]))


def estimators(label: str, small: bool = False, seed: int = 42) -> dict:
    """M2-M4: the three regressors.  Production sizes follow the published settings
    (100 trees depth 20; 100 boosting rounds depth 6, rate 0.1); ``small`` is for tests."""
    trees, depth, rounds, gdepth = (15, 5, 15, 4) if small else (100, 20, 100, 6)
    return {
        "linear_regression": LinearRegression(featuresCol="features", labelCol=label, solver="normal"),
        "random_forest": RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                                               maxDepth=depth, seed=seed),
        "gradient_boosting": GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=gdepth,
                                          stepSize=0.1, seed=seed),
    }


def train_all(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
              models: dict | None = None, small: bool = False):
    """M6: fit every model; returns (fitted pipelines, long predictions, metrics with error rows).

    Null features take the mean of the training rows (the imputer is part of each pipeline, so
    scoring does the same); rows without a label are not trained on.  A failing model yields a
    metrics row with ``error`` set instead of stopping the run, also when every model fails.
    """
    spark = train.sparkSession
    models = models or estimators(label, small=small)
    both = (train.withColumn("__split", F.lit("train")).unionByName(test.withColumn("__split", F.lit("test")))
            .filter(F.col(label).isNotNull()).select(*dict.fromkeys([*key, *features, label]), "__split").checkpoint(eager=True))
    fit_on = both.filter(F.col("__split") == "train")
    fitted, preds, errors = {}, [], []
    for name, est in models.items():
        try:
            pm = Pipeline(stages=[*_inputs(features), est]).fit(fit_on)
            fitted[name] = pm
            preds.append(pm.transform(both).select(*key, F.lit(name).alias("model"), F.col("__split").alias("split"),
                                                   F.col(label).cast("double").alias("label"), "prediction"))
        except Exception as exc:  # noqa: BLE001 - isolate failures per model
            errors.append((name, str(exc)[:500]))
    if preds:
        long = preds[0]
        for p in preds[1:]:
            long = long.unionByName(p)
    else:
        long = both.limit(0).select(*key, F.lit("").alias("model"), F.col("__split").alias("split"),
                                    F.col(label).cast("double").alias("label"), F.lit(0.0).alias("prediction"))
    metrics = regression_metrics(long, by=("model", "split")).withColumn("error", F.lit(None).cast("string"))
    if errors:
        err = spark.createDataFrame(errors, "model string, error string")
        metrics = metrics.unionByName(err, allowMissingColumns=True)
    return fitted, long, metrics


def _inputs(features: Sequence[str]) -> list:
    """Pipeline stages from raw columns to the feature vector: cast, mean imputation, assembly."""
    cast = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `__in_{c}`" for c in features) + " FROM __THIS__")
    mean = Imputer(strategy="mean", inputCols=[f"__in_{c}" for c in features], outputCols=[f"__im_{c}" for c in features])
    return [cast, mean, VectorAssembler(inputCols=[f"__im_{c}" for c in features], outputCol="features")]


def score_batch(fitted: dict, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """M7: every model over the whole table; long (key, model, prediction) clipped, rounded, labelled.

    Without a model there are no predictions: an empty table, which leaves every row to M8's rule."""
    outs = [] if fitted else [df.where(F.lit(False)).select(*key, F.lit("").alias("model"), F.lit(0.0).alias("prediction"))]
    for name, pm in fitted.items():
        p = pm.transform(df).select(*key, F.lit(name).alias("model"), clip("prediction").alias("prediction"))
        outs.append(p)
    long = outs[0]
    for o in outs[1:]:
        long = long.unionByName(o)
    long = long.withColumn("prediction", round_half_even("prediction", 1))
    # the label of a prediction uses the closed-range scale (J3), as the published app does
    return category_by_range(long, "prediction", prefix="__").withColumnRenamed("__category", "category").drop(
        "__color", "__css_class", "__description")


def ensemble(long: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean of the valid model predictions per key, with count, range and category."""
    e = long.groupBy(*key).agg(F.avg("prediction").alias("ensemble"), F.count("prediction").alias("n_models"),
                               F.min("prediction").alias("pred_min"), F.max("prediction").alias("pred_max"))
    e = e.withColumn("ensemble", round_half_even("ensemble", 1))
    return category_by_range(e, "ensemble", prefix="__").withColumnRenamed("__category", "category").drop(
        "__color", "__css_class", "__description")


def with_rule_fallback(predictions: DataFrame, rows: DataFrame, key: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """M8: the ensemble for every row of ``rows``; where no model gave a number, the rule forecast
    (F10) of the row's own measures.  ``source`` says which of the two it is."""
    from aerolith.functions.util import join_null_safe
    rule = rows.select(*key, round_half_even(rule_forecast(ts=ts), 1).alias("__rule"))
    found = predictions.select(*key, "ensemble", "n_models", "pred_min", "pred_max")
    out = (join_null_safe(rule, found, key, "left")
           .withColumn("source", F.when(F.col("ensemble").isNotNull(), "models").otherwise("rule"))
           .withColumn("ensemble", F.coalesce("ensemble", "__rule")).withColumn("n_models", F.coalesce("n_models", F.lit(0))).drop("__rule"))
    return category_by_range(out, "ensemble", prefix="__").withColumnRenamed("__category", "category").drop(
        "__color", "__css_class", "__description")


def needs_training(runs: DataFrame, as_of: Column, hours: int = 24, ts: str = "trained_at",
                   by: Sequence[str] = (), models: Sequence[str] | None = None) -> DataFrame:
    """M9: true when no artefact is younger than ``hours`` (strict: exactly 24 h old -> retrain).

    ``models`` lists the wanted models (values of the one column in ``by``): one row for each, and one
    that has no run needs training."""
    young = F.count_if(F.col(ts) > as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    out = runs.groupBy(*by).agg(F.max(ts).alias("latest_run"), (young == 0).alias("needs_training"))
    if models is None:
        return out
    (name,) = by
    wanted = runs.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(models)], f"`{name}` string")
    return wanted.join(out, name, "left").withColumn("needs_training", F.coalesce("needs_training", F.lit(True)))


def r2_drop_gate(runs: DataFrame, threshold: float = 0.05, by: Sequence[str] = ("model_name",),
                 ts: str = "trained_at", r2: str = "test_r2", tie: Sequence[str] = ()) -> DataFrame:
    """Flag a run whose R^2 fell by more than ``threshold`` (relative) against the previous run.

    Runs are few per model (one per training), so a window per model is small.
    """
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    prev = F.lag(r2, 1).over(w)
    drop = F.try_divide(prev - F.col(r2), F.abs(prev))
    return runs.withColumn("prev_r2", prev).withColumn("relative_drop", drop).withColumn(
        "retrain", F.coalesce(F.col("relative_drop") > threshold, F.lit(False)))


def feature_importance(fitted: dict, features: Sequence[str]) -> DataFrame:
    """Tree feature importances as rows (model, feature, importance); from fitted models."""
    rows = []
    for name, pm in fitted.items():
        m = pm.stages[-1]
        if hasattr(m, "featureImportances"):
            imp = m.featureImportances.toArray().tolist()
            rows += [(name, f, float(v)) for f, v in zip(features, imp)]
    from pyspark.sql import SparkSession
    # one row per (model, feature): bounded by the model count and feature width
    return SparkSession.getActiveSession().createDataFrame(rows, "model string, feature string, importance double")
