"""Structured Streaming operators.

All run on micro-batches with checkpoints in the shared checkpoint folder, so a
restarted query resumes where it stopped; ``foreachBatch`` writers are
idempotent under batch replay (they overwrite, keyed by batch id, never append
blindly).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from aerolith.functions.util import path_exists
from aerolith.operators.joins import upsert_rows
from aerolith.session import scratch_path
from aerolith.sources.payloads import decode_air, decode_weather
from aerolith.sources.store import rows_of_partitions
from aerolith.sources.testdata import readings_from_events


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """File source over parquet events; ``ts`` cast to TIMESTAMP for watermarks."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def event_time(ts: str = "timestamp"):
    """Wall-clock TIMESTAMP_NTZ -> TIMESTAMP read as UTC, whatever the session time zone
    (watermarks need TIMESTAMP; hour windows then align with wall-clock hours)."""
    t = F.col(ts)
    micros = F.second(t).cast("long") * 1000000 + F.date_format(t, "SSSSSS").cast("long")
    secs = (micros.cast("decimal(14,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(8,6)")
    return F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), secs, F.lit("UTC"))


def readings_stream(events: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Readings of an event stream with their event time; ``extra`` names event columns to keep."""
    rd = readings_from_events(events, extra)
    return rd.withColumn("event_time", event_time("timestamp"))


def _run(query_builder, checkpoint: str):
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# --- T1 -----------------------------------------------------------------------------------------------------------


def stream_combine_payloads(weather: DataFrame, air: DataFrame, delay: str = "2 hours", air_order: str = "event_id") -> DataFrame:
    """J1 on two streams of raw payloads (``city, timestamp, event_time, payload``): one reading per city and hour.

    Each side keeps, per city and hour, the payload it would keep in a batch (weather: newest timestamp; air: largest
    ``air_order``) until the watermark closes the hour, either side arriving up to ``delay`` late.  The two closed
    hours are joined, one row each, and decoded (S5, S6); on equal names the air side wins.  Rows without a
    city match nothing, as in the batch form.
    """
    def closed(stream, order, name):
        return (stream.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 hour").alias("w"), "city")
                .agg(F.max_by(F.struct("timestamp", "payload"), F.col(order)).alias(name)))
    both = closed(weather, "timestamp", "__weather").join(closed(air, air_order, "__air"), ["w", "city"])
    flat = both.select("city", F.col("__air.timestamp").alias("timestamp"), F.col("__weather.payload").alias("__wp"), F.col("__air.payload").alias("__ap"))
    flat = decode_weather(flat, "__wp", keep=["city", "timestamp", "__ap"])
    names = [c for c in flat.columns if c != "__ap"]
    air_side = decode_air(flat, "__ap", keep=names)
    return air_side.withColumn("hour_ts", F.date_trunc("hour", "timestamp"))


def stream_ingest_upsert(stream: DataFrame, store_path: str, key: Sequence[str], checkpoint: str,
                         ordinal: str | None = None) -> None:
    """Each micro-batch is upserted (J2a) into a parquet store partitioned by (city, date).

    Only the partitions that the batch touches are read and rewritten (dynamic overwrite)."""
    key = list(key)

    def upsert(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        b = batch.withColumn("date", F.to_date("timestamp"))
        current = b.limit(0)  # no store yet: the batch is deduplicated like any other
        if path_exists(spark, store_path):
            touched = b.select("city", "date").distinct().checkpoint(eager=True)
            current = rows_of_partitions(spark.read.schema(b.schema).parquet(store_path), touched, ["city", "date"])
        merged = upsert_rows(current, b, key + ["date"], ordinal=ordinal)
        # materialise before overwriting the partitions it was read from
        merged = merged.checkpoint(eager=True)
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("city", "date").parquet(store_path))

    _run(stream.writeStream.foreachBatch(upsert), checkpoint)


# --- T2 / T3 ------------------------------------------------------------------------------------------------------


def stream_hourly_mean(stream: DataFrame, delay: str = "2 hours", value: str = "aqi") -> DataFrame:
    """Tumbling one-hour mean per city, emitted once the watermark closes the window."""
    return (stream.withWatermark("event_time", delay)
                  .groupBy(F.window("event_time", "1 hour").alias("w"), "city")
                  .agg(F.min(F.date_trunc("hour", "timestamp")).alias("hour_start"),
                       F.avg(value).alias(f"{value}_mean"), F.count(F.lit(1)).alias("n"))
                  .select("city", "hour_start", f"{value}_mean", "n"))


def stream_dedupe(stream: DataFrame, key: Sequence[str] = ("city", "event_time"), delay: str = "2 hours") -> DataFrame:
    """One row per key within the watermark (keeps the first arrival; the batch store keeps
    the last, see README)."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(key))


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    _run(df.writeStream.format("parquet").option("path", out).outputMode(mode), checkpoint)


# --- T4 / T5: keyed state with event-time timers ------------------------------------------------------------------


def _columns_of(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def _micros(frame: pd.Series) -> list[int]:
    return frame.astype("datetime64[us]").astype("int64").tolist()


def stream_change_rate(stream: DataFrame, value: str = "aqi", by: Sequence[str] = ("city",), ts: str = "timestamp",
                       tie: str | None = None, delay: str = "2 hours") -> DataFrame:
    """T4: W3 + W4 on a stream: ``by, ts, value, {value}_change_rate, {value}_ma_3h`` in append mode.

    The state of a series is its rows that the watermark has not passed and the last two values sent.  Rows wait
    until no earlier one can arrive: when the watermark passes them they are sent in (``ts``, ``tie``) order,
    woken by an event-time timer if the series brings no rows of its own.  So rows up to ``delay`` late, in any
    order and over any batches, get the neighbours that the batch form gives them; later ones are dropped by the
    watermark.  ``tie`` (a whole number) orders rows of one time; null and NaN values count as null, a null key is a series.
    A series' state holds its rows of the last ``delay`` of event time.
    """
    by = list(by)
    tied = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    rows = stream.withWatermark("event_time", delay).select(*by, "event_time", F.col(ts).alias("__ts"), tied.alias("__tie"), F.col(value).cast("double").alias("__v"))
    names = [*by, ts, value, f"{value}_change_rate", f"{value}_ma_3h"]

    def step(key, frames, state):
        waiting: list[tuple[int, int, float | None]] = []
        recent: list[float | None] = []
        if state.exists:
            at, ties, values, recent = (list(x) for x in state.get)
            waiting = list(zip(at, ties, values))
        for frame in frames:
            values = [None if v is None or v != v else float(v) for v in frame["__v"]]
            waiting.extend(zip(_micros(frame["__ts"]), frame["__tie"].tolist(), values))
        waiting.sort(key=lambda r: (r[0], r[1]))
        passed = state.getCurrentWatermarkMs() * 1000
        n = sum(at < passed for at, _, _ in waiting)
        out = []
        for at, _, v in waiting[:n]:
            before = recent[-1] if recent else None
            held = [x for x in (*recent, v) if x is not None]
            out.append((*key, at, v, 0.0 if v is None or before is None else v - before, sum(held) / len(held) if held else None))
            recent = [*recent, v][-2:]
        waiting = waiting[n:]
        state.update(([r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting], recent))
        if waiting:
            state.setTimeoutTimestamp(waiting[0][0] // 1000)
        if out:
            frame = pd.DataFrame(out, columns=names)
            frame[ts] = pd.to_datetime(frame[ts], unit="us")
            yield frame.astype({c: "float64" for c in names[-3:]})

    kept = "at array<bigint>, tie array<bigint>, value array<double>, recent array<double>"
    sent = (rows.groupBy(*by).applyInPandasWithState(step, f"{_columns_of(rows, by)}, `{ts}` timestamp_ntz, {', '.join(f'`{c}` double' for c in names[-3:])}",
                                                     kept, "append", GroupStateTimeout.EventTimeTimeout))
    return sent.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names[-3:]})


def stream_freshness(stream: DataFrame, silent_hours: float = 1, by: Sequence[str] = ("city",), ts: str = "timestamp", delay: str = "0 seconds") -> DataFrame:
    """T5: ``by, last_seen, silent`` in append mode: a row with ``silent`` false whenever a series' newest time advances,
    one with true when the watermark (the newest time of all series less ``delay``) passes it by more than ``silent_hours``.

    The second comes from an event-time timer of the series: no reading of its own is needed, any series that
    moves the watermark on sets it off, once per silence (a micro-batch that ends the silence tells of both).  A null
    key is a series.
    """
    by, silence = list(by), int(silent_hours * 3_600_000_000)
    rows = stream.withWatermark("event_time", delay).select(*by, "event_time", F.col(ts).alias("__ts"))
    names = [*by, "last_seen", "silent"]

    def step(key, frames, state):
        last, told = state.get if state.exists else (None, False)
        out, passed = [], state.getCurrentWatermarkMs() * 1000
        newest = max((max(_micros(f["__ts"])) for f in frames if len(f)), default=None)
        advances = newest is not None and (last is None or newest > last)
        if last is not None and not told and last + silence < passed:
            told = True
            out.append((*key, last, True))
        if advances:
            last, told = newest, False
            out.append((*key, last, False))
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(max((last + silence) // 1000, passed // 1000))
        if out:
            frame = pd.DataFrame(out, columns=names)
            frame["last_seen"] = pd.to_datetime(frame["last_seen"], unit="us")
            yield frame

    return rows.groupBy(*by).applyInPandasWithState(step, f"{_columns_of(rows, by)}, last_seen timestamp_ntz, silent boolean", "last bigint, told boolean", "append",
                                                    GroupStateTimeout.EventTimeTimeout)


def fresh_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders under the shared checkpoint folder, unique per run."""
    tag = f"{name}-{uuid.uuid4().hex[:12]}"
    return scratch_path(spark, f"{tag}/out"), scratch_path(spark, f"{tag}/chk")
