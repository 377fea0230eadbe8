"""Reading store: read, idempotent write, predicate scan, delete, metadata, reports,
metrics log and model artefacts (S1-S4, S7-S12)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.util import join_null_safe, nan_to_null
from aerolith.sources.schema import READING_SCHEMA


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", ts: str = "timestamp") -> DataFrame:
    """Load history; parquet keeps its stored schema, CSV columns are taken by header name.

    Columns of the declared schema are cast to its types and added as NULL when the file has none;
    other columns of the file stay as text.  A CSV cell that is no value of its type becomes NULL (A13
    counts them), and NaN measures do.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        declared = {f.name: f for f in READING_SCHEMA.fields}
        have = [F.col(f"`{c}`").try_cast(declared[c].dataType).alias(c) if c in declared else F.col(f"`{c}`") for c in raw.columns]
        absent = [F.lit(None).cast(f.dataType).alias(n) for n, f in declared.items() if n not in raw.columns]
        df = raw.select(*have, *absent)
    else:
        df = spark.read.format(fmt).load(path)
    if ts in df.columns:
        df = df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    return df.withColumns({c: nan_to_null(c) for c, t in df.dtypes if t in ("double", "float")})


def write_readings(df: DataFrame, path: str, ts: str = "timestamp", partition_by: Sequence[str] = ("city", "date")) -> None:
    """Idempotent rewrite of the touched (city, date) partitions only (dynamic overwrite)."""
    out = df.withColumn("date", F.to_date(ts)) if "date" in partition_by and "date" not in df.columns else df
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(path))


def scan_collection(df: DataFrame, predicate: Column | None = None, order: Sequence = ("timestamp",)) -> DataFrame:
    """S3: predicate + sort scan; the predicate reaches the parquet reader as a pushed filter."""
    d = df.filter(predicate) if predicate is not None else df
    return d.orderBy(*order)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that do not match; a NULL predicate keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def rows_of_partitions(store: DataFrame, touched: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows of a partitioned table in the partitions that ``touched`` (materialised; columns ``part``) lists.

    Partitions without a null are an equi-join with the list, which prunes the folders read, inside the range of its
    values (one row of bounds); those with a null key are read by a filter on it and matched null-safe.
    """
    part = list(part)
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in part])
    bounds = touched.where(~some_null).agg(*[f(c).alias(f"{n}_{c}") for c in part for n, f in (("low", F.min), ("high", F.max))]).first()
    within = reduce(lambda a, b: a & b, [F.col(c).between(F.lit(bounds[f"low_{c}"]), F.lit(bounds[f"high_{c}"])) for c in part])
    named = store.where(within).join(F.broadcast(touched.where(within).select(*part)), part, "left_semi")
    return named.select(*store.columns).unionByName(join_null_safe(store.where(some_null), touched.where(some_null).select(*part), part, "left_semi"))


def delete_from_store(spark: SparkSession, path: str, predicate: Column,
                      partition_by: Sequence[str] = ("city", "date")) -> int:
    """S4 on a stored table: rewrite only the partitions holding matching rows, without them.

    The kept rows of the touched partitions are materialised (checkpoint in the
    shared folder) before the dynamic overwrite, because they are read from the
    same files.  Partitions left without rows are removed (a dynamic overwrite
    never receives rows for them).  Returns the number of deleted rows.
    """
    part = list(partition_by)
    store = spark.read.parquet(path)
    hit = F.coalesce(predicate, F.lit(False))
    touched = store.filter(hit).groupBy(*part).agg(F.count(F.lit(1)).alias("__n")).checkpoint(eager=True)
    n_deleted = touched.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    if n_deleted == 0:
        return 0
    keep = rows_of_partitions(store, touched, part).filter(~hit).checkpoint(eager=True)
    (keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*part).parquet(path))
    # partitions that lost every row: at most as many as the store has folders
    left = keep.groupBy(*part).agg(F.lit(1).alias("__left"))
    emptied = join_null_safe(touched, left, part, "left").filter(F.col("__left").isNull()).select(*part).collect()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in emptied:
        levels = [name(c, None if row[c] is None else str(row[c])) for c in part]
        for depth in range(len(levels), 0, -1):  # the partition, then parents left empty
            p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{'/'.join(levels[:depth])}")
            fs = p.getFileSystem(conf)
            if fs.exists(p) and (depth == len(levels) or len(fs.listStatus(p)) == 0):
                fs.delete(p, True)
    return n_deleted


def store_metadata(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One-row metadata: total rows, column list, null count per column, first / last timestamp."""
    cols = df.columns
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.array(*[F.lit(c) for c in cols]).alias("features"),
        F.struct(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).alias("missing_values"),
        F.date_format(F.min(ts), "yyyy-MM-dd'T'HH:mm:ss").alias("start"),
        F.date_format(F.max(ts), "yyyy-MM-dd'T'HH:mm:ss").alias("end"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """One-row nested report document as JSON (one file)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def sample_plot_frame(df: DataFrame, cols: Sequence[str], key: Sequence[str], buckets: int = 100,
                      keep: int = 1) -> DataFrame:
    """Deterministic point set for charts: rows whose key hash falls into ``keep`` of ``buckets``.

    A sampling operator: it is the feature, and it is stable under
    repartitioning because it depends only on the key.
    """
    h = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets))
    return df.filter(h < keep).select(*cols)


# --- S8 / S9 / S10: metrics and models ------------------------------------------------------------------------

METRIC_COLUMNS = ["train_mae", "train_rmse", "train_r2", "test_mae", "test_rmse", "test_r2"]


def log_metrics(runs: DataFrame, path: str) -> None:
    """Append flat metric rows (model_name, trained_at, metrics, sample counts) to ``model_runs``."""
    runs.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_nested_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested per-run documents ``{model: {metric: value} | {error}}`` -> long rows.

    ``multi_line``: one pretty-printed document per file (the published form);
    False for JSON-lines files with one run per line.
    """
    raw = spark.read.option("multiLine", multi_line).json(path).withColumn("__file", F.input_file_name())
    models = [f.name for f in raw.schema.fields if f.name != "__file"]
    parts = []
    for m in models:
        fields = raw.schema[m].dataType.fieldNames()
        cols = [F.col(f"`{m}`.{c}").cast("double").alias(c) if c in fields else F.lit(None).cast("double").alias(c)
                for c in METRIC_COLUMNS]
        err = F.col(f"`{m}`.error") if "error" in fields else F.lit(None).cast("string")
        parts.append(raw.select("__file", F.lit(m).alias("model_name"), *cols, err.alias("error"))
                     .filter(F.col(f"`{m}`").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("__file", "source")


def model_comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per model, display name and metric text."""
    from aerolith.functions.scalars import fmt, title_model_name
    return metrics.select(title_model_name("model_name").alias("Model"), fmt("test_mae", "%.3f").alias("MAE"),
                          fmt("test_rmse", "%.3f").alias("RMSE"), fmt("test_r2", "%.3f").alias("R2"))


def save_model(model, path: str) -> None:
    """Persist a fitted ML pipeline (includes scaler and feature list)."""
    model.write().overwrite().save(path)


def load_latest_model(spark: SparkSession, runs: DataFrame, model_name: str):
    """Load the newest artefact of one model type listed in ``model_runs``."""
    from pyspark.ml import PipelineModel
    row = (runs.filter(F.col("model_name") == model_name)
               .agg(F.max_by("model_path", "trained_at").alias("p")).first())
    return PipelineModel.load(row["p"]) if row and row["p"] else None
