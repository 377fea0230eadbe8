"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import ensure_checkpoint_dir


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match each other (``<=>``); keeps one copy of the keys."""
    on = list(on)
    if not on:
        raise ValueError("join keys required (add a constant key for one global group)")
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        e = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in on})
    return out.drop(*[f"__r_{c}" for c in on])


#: Largest table that ``attach`` broadcasts after measuring it, and copies of each statistics row beyond that.
BROADCAST_BYTES, SALTS = 64 << 20, 32


def _planner_broadcasts(df: DataFrame) -> bool:
    """Whether the optimizer's own estimate lets it broadcast ``df``."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit
    except ValueError:  # estimates multiply at joins: one of thousands of digits does not convert, and is not small
        return False


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` from its rows, 16 bytes a column, and the lengths of its texts."""
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    got = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]).first()
    return got[0] * 16 * (1 + len(df.columns)) + sum(got[1:])


def attach(rows: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner", measure: bool = True) -> DataFrame:
    """``rows`` joined with their group's row of ``stats`` (unique in ``on``; null keys match), rows staying in place.

    Where the optimizer's estimate is small it broadcasts ``stats`` by itself.  Otherwise ``stats`` is computed
    into the shared checkpoint folder and measured: up to BROADCAST_BYTES it is broadcast.  Beyond that, and
    without ``measure`` (no job runs while the plan is made), each of its rows is copied SALTS times and a
    row's own salt is its partition's number, so a group's rows go to SALTS tasks instead of one.
    """
    if not _planner_broadcasts(stats):
        if measure:
            ensure_checkpoint_dir(rows.sparkSession)
            stats = stats.checkpoint(eager=True)
            if measured_bytes(stats) <= BROADCAST_BYTES:
                return join_null_safe(rows, F.broadcast(stats), on, how)
        stats = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        return join_null_safe(rows, stats, [*on, "__salt"], how).drop("__salt")
    return join_null_safe(rows, stats, on, how)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    """Wide -> long over ``cols`` (all cast to double)."""
    d = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot(list(ids), list(cols), var, val)


def nan_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = ("double", "float", "int", "bigint", "smallint", "tinyint") 
    return [c for c, t in df.dtypes if (t in num or t.startswith("decimal")) and c not in exclude]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file exists, on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
