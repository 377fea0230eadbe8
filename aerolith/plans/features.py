"""Feature plans: the training frame (W10) and the scheduled feature job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.scalars import calendar_parts, cyclic, interaction
from aerolith.operators.windows import DEFAULT_CHUNK, LAG_OFFSETS, LAG_PREFIX, change_and_rolling, lags, target_ahead


def training_frame(h: DataFrame, ahead: int = 24, days: int | None = None, as_of: Column | None = None,
                   by=("city",), ts: str = "timestamp", chunk: int = DEFAULT_CHUNK,
                   lag_offsets=LAG_OFFSETS, lag_cols=None) -> DataFrame:
    """Target ``ahead`` rows later -> drop rows without target -> calendar + cyclic hour
    -> lags of aqi / pm2.5 / temperature over the *remaining* rows -> drop rows with any null.

    Two window stages with a filter between them: the lag positions count only
    rows that kept a target, as in the published frame.
    """
    if days is not None:
        ref = as_of if as_of is not None else h.agg(F.max(ts)).scalar()
        h = h.filter(F.col(ts) >= ref - F.expr(f"INTERVAL {int(days)} DAYS"))
    t = target_ahead(h, "aqi", ahead, by=by, order=ts, chunk=chunk)
    # the lag stage indexes the surviving rows again and reads its input twice (rows and
    # per-bucket counts): cut the lineage here (shared checkpoint folder) so the
    # upstream scan, aggregation and first window stage run once
    from aerolith.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(t.sparkSession)
    t = t.checkpoint(eager=True)
    t = calendar_parts(t, ts, parts=["hour", "day_of_week", "month"])
    s, c = cyclic("hour", 24)
    t = t.withColumn("hour_sin", s).withColumn("hour_cos", c)
    t = lags(t, lag_cols or LAG_PREFIX, lag_offsets, by=by, order=ts, chunk=chunk)
    return t.na.drop()


def ci_features(df: DataFrame, by=("city",), ts: str = "timestamp", last_hours: int | None = None,
                as_of: Column | None = None, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Calendar (6 parts) -> change rate -> 3-row mean -> temperature x humidity.

    The whole history is the look-back context; ``last_hours`` restricts the
    rows returned (the published job only reads the last hour).
    """
    f = calendar_parts(df, ts)
    f = change_and_rolling(f, "aqi", by=by, order=ts, chunk=chunk)
    f = f.withColumn("temp_humidity_interaction", interaction("temperature", "humidity"))
    if last_hours is not None:
        ref = as_of if as_of is not None else df.agg(F.max(ts)).scalar()
        f = f.filter(F.col(ts) >= ref - F.expr(f"INTERVAL {int(last_hours)} HOURS"))
    return f
