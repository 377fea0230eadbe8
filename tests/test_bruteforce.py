"""Rows-only operators against brute-force NumPy on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from aerolith.operators import cluster as C
from aerolith.operators import ml as M
from aerolith.sources.testdata import hourly
from tests.conftest import SF001

COLS = ["temperature", "humidity", "pm2_5"]


def test_linear_regression_matches_least_squares(spark):
    h = hourly(spark, SF001).select(*COLS, F.col("aqi").alias("y"))
    fitted, long, metrics = M.train_all(h, h, COLS, "y", COLS, models={"linear_regression": M.estimators("y")["linear_regression"]})
    lr = fitted["linear_regression"].stages[-1]
    pdf = h.toPandas()
    X = np.column_stack([pdf[COLS].to_numpy(), np.ones(len(pdf))])
    beta, *_ = np.linalg.lstsq(X, pdf["y"].to_numpy(), rcond=None)
    assert np.allclose(lr.coefficients.toArray(), beta[:-1], rtol=1e-6, atol=1e-8)
    assert abs(lr.intercept - beta[-1]) < 1e-6
    pred = X @ beta
    mae = np.mean(np.abs(pdf["y"].to_numpy() - pred))
    got = metrics.filter("split = 'train'").first()["mae"]
    assert abs(got - mae) < 1e-6


def test_pca_explained_variance_matches_svd(spark):
    h = hourly(spark, SF001)
    scored, ev = C.pca2(h, COLS)
    pdf = h.select(*COLS).toPandas().to_numpy()
    z = (pdf - pdf.mean(axis=0)) / pdf.std(axis=0, ddof=1)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(ev, (s / s.sum())[:2], atol=1e-9)
    assert scored.count() == len(pdf)


def test_scaler_uses_population_std(spark):
    h = hourly(spark, SF001).select("aqi")
    z = M.scale_features(h, ["aqi"]).toPandas()["aqi"].to_numpy()
    raw = h.toPandas()["aqi"].to_numpy()
    assert np.allclose(np.sort(z), np.sort((raw - raw.mean()) / raw.std(ddof=0)))
