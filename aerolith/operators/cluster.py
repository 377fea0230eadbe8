"""Clustering, PCA and isolation forest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators.ml import scale_features


def assemble_scaled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Vector of z-scaled columns (M1: population std).  Rows with a null in ``cols`` are dropped."""
    z = scale_features(df.na.drop(subset=list(cols)), cols, suffix="__z")
    v = VectorAssembler(inputCols=[f"{c}__z" for c in cols], outputCol=out).transform(z)
    return v.drop(*[f"{c}__z" for c in cols])


def kmeans_auto_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 8), seed: int = 42,
                  max_iter: int = 20, distance: str = "euclidean", n_init: int = 10):
    """Fit k-means for each k (best of ``n_init`` seeds by inertia); silhouette from
    Spark's evaluator (squared Euclidean) and inertia per k; returns (best k, labelled rows,
    elbow table)."""
    spark = df.sparkSession
    # fitted 60 times and read by the labelled rows: one checkpoint, not one scan a fit
    x = assemble_scaled(df, cols).checkpoint(eager=True)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", distanceMeasure="squaredEuclidean"
                             if distance == "squaredEuclidean" else "cosine" if distance == "cosine" else
                             "squaredEuclidean")
    rows, best = [], None
    for k in ks:
        m = None
        for r in range(n_init):
            cand = KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(x)
            if m is None or cand.summary.trainingCost < m.summary.trainingCost:
                m = cand
        pred = m.transform(x)
        sil = float(ev.evaluate(pred))
        rows.append((int(k), float(m.summary.trainingCost), sil))
        if best is None or sil > best[1]:
            best = (k, sil, pred)
    elbow = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    return best[0], best[2].drop("features"), elbow


def pca2(df: DataFrame, cols: Sequence[str], k: int = 2):
    """First ``k`` principal components of the z-scaled columns + explained variance."""
    x = assemble_scaled(df, cols)
    m = PCA(k=k, inputCol="features", outputCol="pca").fit(x)
    from pyspark.ml.functions import vector_to_array
    t = m.transform(x)
    arr = vector_to_array(t["pca"])
    scored = t.select("*", *[arr[i].alias(f"pc{i + 1}") for i in range(k)]).drop("features", "pca")
    ev = [float(v) for v in m.explainedVariance.toArray()]
    return scored, ev


# --- X3: isolation forest (Liu, Ting, Zhou 2008) --------------------------------------------------------------

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (1 for two rows)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    idx = len(nodes)
    if depth >= limit or len(x) <= 1 or np.all(x.max(axis=0) == x.min(axis=0)):
        nodes.append((-1, 0.0, -1, -1, float(len(x))))
        return idx
    lo, hi = x.min(axis=0), x.max(axis=0)
    cand = np.flatnonzero(hi > lo)
    f = int(rng.choice(cand))
    s = float(rng.uniform(lo[f], hi[f]))
    nodes.append(None)
    left = _grow(x[x[:, f] < s], rng, depth + 1, limit, nodes)
    right = _grow(x[x[:, f] >= s], rng, depth + 1, limit, nodes)
    nodes[idx] = (f, s, left, right, float(len(x)))
    return idx


def _arrays(nodes):
    feat = np.array([nd[0] for nd in nodes], dtype=np.int64)
    thr = np.array([nd[1] for nd in nodes], dtype=float)
    left = np.array([max(nd[2], 0) for nd in nodes], dtype=np.int64)
    right = np.array([max(nd[3], 0) for nd in nodes], dtype=np.int64)
    tail = np.array([_c(nd[4]) for nd in nodes])  # what a leaf of that size adds to the path
    return feat, thr, left, right, tail


def _path_lengths(x: np.ndarray, arrays) -> np.ndarray:
    """Vectorised traversal of one tree for all rows of a batch."""
    feat, thr, left, right, tail = arrays
    n = len(x)
    cur = np.zeros(n, dtype=np.int64)
    depth = np.zeros(n)
    rows = np.arange(n)
    while True:
        f = feat[cur]
        internal = f >= 0
        if not internal.any():
            break
        go_left = x[rows, np.maximum(f, 0)] < thr[cur]
        cur = np.where(internal, np.where(go_left, left[cur], right[cur]), cur)
        depth += internal
    return depth + tail[cur]


def tree_candidates(d: DataFrame, sizes: DataFrame, by, cols, key, n_trees: int, sample_size: int, seed: int) -> DataFrame:
    """Rows that each tree of a group may sample, about 2 * sample_size a tree, with their hash ``__u``."""
    from aerolith.functions.util import join_null_safe
    keyh = [F.col(k) for k in key]
    u0 = F.pmod(F.xxhash64(*keyh, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    pool = (join_null_safe(d, sizes, by)
            .filter(u0 < F.least(F.lit(1.0), F.lit(2.0 * sample_size * n_trees) / F.col("__n"))))
    u = F.pmod(F.xxhash64(*keyh, F.col("tree"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (pool.select(*by, "__n", *cols, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"),
                        *[k for k in key if k not in by])
                .withColumn("__u", u)
                # of m pool rows a tree's sample_size smallest hashes lie below 2 * sample_size / m but
                # for a chance that falls exponentially in sample_size
                .filter(F.col("__u") < F.least(F.lit(1.0), F.greatest(F.lit(1.0 / n_trees), F.lit(2.0 * sample_size) / F.col("__n")))))


def isolation_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str], by: Sequence[str] = ("city",),
                     n_trees: int = 100, sample_size: int = 256, contamination: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """X3 (re-aimed, not in MLlib): per group, ``n_trees`` isolation trees, each grown from a
    bounded random subsample of ``sample_size`` rows, score every row, flag the top
    ``contamination`` share (above the exact per-group quantile).

    * sampling: one hash per row keeps a uniform pool of about
      2 * n_trees * sample_size rows per group (no per-tree work on the other
      rows); each pool row then draws a hash per tree, and the tree builder takes
      the ``sample_size`` smallest, so at most a few hundred rows per tree reach
      Python;
    * building: ``applyInPandas`` per (group, tree), about 2 * sample_size rows each;
    * scoring: rows are hashed into buckets of their group and cogrouped with its trees.
    """
    from aerolith.functions.quantiles import quantile_columns
    from aerolith.functions.util import attach
    by, cols, key = list(by), list(cols), list(key)
    if not by:  # one global forest: a constant group key
        out = isolation_forest(df.withColumn("__all", F.lit(0)), cols, key, ["__all"], n_trees, sample_size,
                               contamination, seed)
        return out.drop("__all")
    d = df.na.drop(subset=cols).select(*by, *[k for k in key if k not in by], *cols)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    cand = tree_candidates(d, sizes, by, cols, key, n_trees, sample_size, seed)
    limit = int(np.ceil(np.log2(max(sample_size, 2))))
    tree_schema = T.StructType([*[d.schema[c] for c in by], T.StructField("tree", T.IntegerType()),
                                T.StructField("nodes", T.StringType()), T.StructField("n", T.DoubleType())])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.nsmallest(sample_size, "__u")
        x = pdf[cols].to_numpy(dtype=float)
        nodes: list = []
        _grow(x, np.random.default_rng(seed * 1000 + t), 0, limit, nodes)
        row = {c: pdf[c].iloc[0] for c in by}
        row.update(tree=t, nodes=repr(nodes), n=float(len(x)))
        return pd.DataFrame([row])

    forest_df = cand.select(*by, "tree", "__u", *cols).groupBy(*by, "tree").applyInPandas(build, tree_schema)
    out_schema = T.StructType([*d.schema.fields, T.StructField("anomaly_score", T.DoubleType())])
    scored = _score_cogrouped(d, sizes, forest_df, by, key, cols, out_schema)
    cut = quantile_columns(scored, by, "anomaly_score", [1 - contamination], ["threshold"])
    return attach(scored, cut, by).withColumn("is_anomaly", F.col("anomaly_score") > F.col("threshold"))


ROWS_PER_SCORING_BUCKET = 1_000_000


def _score_cogrouped(d, sizes, forest_df, by, key, cols, out_schema):
    """Scoring for many groups: rows are hashed into ceil(n / 1M) buckets per group, and each
    bucket is cogrouped with its group's trees, so a forest travels once per bucket and a hot
    group is spread over many tasks."""
    from aerolith.functions.util import join_null_safe
    nb = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(ROWS_PER_SCORING_BUCKET))).cast("int")
    sz = sizes.select(*by, nb.alias("__nb"))
    rows = join_null_safe(d, sz, by).withColumn(
        "__bucket", F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.col("__nb")).cast("int")).drop("__nb")
    trees = join_null_safe(forest_df, sz, by).withColumn(
        "__bucket", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))).drop("__nb")
    out_cols = [f.name for f in out_schema.fields]
    import ast

    def score(rpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if rpdf.empty:
            return pd.DataFrame(columns=out_cols)
        x = rpdf[cols].to_numpy(dtype=float)
        acc = np.zeros(len(x))
        for _, tr in tpdf.iterrows():
            acc += _path_lengths(x, _arrays(ast.literal_eval(tr["nodes"])))
        n = float(tpdf["n"].iloc[0]) if len(tpdf) else 1.0
        res = np.power(2.0, -(acc / max(len(tpdf), 1)) / _c(n)) if len(tpdf) else np.full(len(x), np.nan)
        return rpdf.assign(anomaly_score=res)[out_cols]

    return (rows.groupBy(*by, "__bucket").cogroup(trees.groupBy(*by, "__bucket"))
                .applyInPandas(score, out_schema))
