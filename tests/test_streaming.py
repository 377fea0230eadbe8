"""Streams equal their batch counterparts, also across several micro-batches."""

import datetime as dt
import random
import time
import uuid

from pyspark.sql import functions as F

from aerolith.session import scratch_path
from aerolith.sources.testdata import readings_from_events, table
from aerolith.streaming import streams as T
from tests.conftest import SF001


def _split_events(spark, parts=4):
    ev = table(spark, SF001, "events")
    src = scratch_path(spark, f"ev-{uuid.uuid4().hex[:8]}")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / parts
    for k in range(parts):
        a, b = lo + step * k, lo + step * (k + 1)
        cond = (F.col("ts") >= a) & ((F.col("ts") < b) if k < parts - 1 else F.lit(True))
        ev.filter(cond).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the file source orders files by modification time
    return src, ev.schema


ROWS = "city string, timestamp timestamp_ntz, aqi double, event_id long"
START = dt.datetime(2024, 3, 1)


def _stream_of(spark, batches):
    """A stream whose micro-batches are the given lists of (city, minutes, value, id)."""
    src = scratch_path(spark, f"rows-{uuid.uuid4().hex[:8]}")
    for rows in batches:
        made = [(c, START + dt.timedelta(minutes=m), v, i) for c, m, v, i in rows]
        spark.createDataFrame(made, ROWS).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the file source orders files by modification time
    schema = spark.read.parquet(src).schema
    return T.event_stream(spark, src, schema, max_files=1).withColumn("event_time", T.event_time("timestamp"))


def _plain_changes(rows):
    out = {}
    for city in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == city), key=lambda r: (r[1], r[3]))
        for k, (_, minute, v, _) in enumerate(own):
            near = [r[2] for r in own[max(0, k - 2):k + 1] if r[2] is not None]
            before = own[k - 1][2] if k else None
            out.setdefault(city, []).append((minute, v, 0.0 if v is None or before is None else v - before, sum(near) / len(near) if near else None))
    return out


def test_change_rate_with_late_tied_and_null_city_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(0, 600, 7), rng.choice([None, 1.0, 2.0, 5.0, 9.5]), i) for i in range(300)]
    batches = [[], [], [], []]
    for r in rows:  # up to 100 minutes late, in any order inside a batch
        batches[min(3, (r[1] + rng.choice([0, 0, 50, 100])) // 160)].append(r)
    for x in batches:
        rng.shuffle(x)
    too_late = ("a", 1, 77.0, 900)  # the watermark has long passed it when the last batch comes
    batches[3] += [too_late, ("late end", 1000, 1.0, 901)]
    out, chk = T.fresh_dirs(spark, "t4-test")
    T.run_to_parquet(T.stream_change_rate(_stream_of(spark, batches), tie="event_id", delay="2 hours"), out, chk)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.city, []).append((int((r.timestamp - START).total_seconds() // 60), r.aqi, r.aqi_change_rate, r.aqi_ma_3h))
    want = _plain_changes(rows)
    assert set(got) == set(want)  # the newest row of all is still waiting
    for city in want:
        assert sorted(got[city], key=str) == sorted(want[city], key=str), city


def test_a_silent_city_is_told_without_a_batch_of_its_own(spark):
    batches = [[("a", 0, 1.0, 1), ("b", 0, 1.0, 2), (None, 5, 1.0, 3)], [("a", 200, 1.0, 4)], [("a", 210, 1.0, 5), ("b", 205, 1.0, 6)], [("a", 300, 1.0, 7)]]
    out, chk = T.fresh_dirs(spark, "t5-test")
    T.run_to_parquet(T.stream_freshness(_stream_of(spark, batches), silent_hours=1), out, chk)
    got = sorted(((r.city or "", int((r.last_seen - START).total_seconds() // 60), r.silent) for r in spark.read.parquet(out).collect()))
    assert got == [("", 5, False), ("", 5, True), ("a", 0, False), ("a", 200, False), ("a", 210, False), ("a", 300, False),
                   ("b", 0, False), ("b", 0, True), ("b", 205, False), ("b", 205, True)]


def test_merge_reads_only_the_partitions_of_the_batch(spark):
    from aerolith.sources.store import rows_of_partitions, write_readings
    path = scratch_path(spark, f"store-{uuid.uuid4().hex[:8]}")
    rows = [(c, START + dt.timedelta(days=k), float(k)) for c in ("a", "b", None) for k in range(4)]
    write_readings(spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double"), path)
    touched = spark.createDataFrame([("a", START.date()), (None, START.date() + dt.timedelta(days=2)), ("zz", START.date())], "city string, date date").checkpoint()
    df = rows_of_partitions(spark.read.parquet(path), touched, ["city", "date"])
    assert sorted(((r.city, r.aqi) for r in df.collect()), key=str) == [("a", 0.0), (None, 2.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "isnull(city" in plan


def test_payload_streams_are_joined_by_hour_with_one_side_late(spark):
    def files(name, batches):
        src = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
        for rows in batches:
            made = [(c, START + dt.timedelta(minutes=m), i, p) for c, m, i, p in rows]
            spark.createDataFrame(made, "city string, timestamp timestamp_ntz, event_id long, payload string").coalesce(1).write.mode("append").parquet(src)
            time.sleep(1.1)
        return T.event_stream(spark, src, spark.read.parquet(src).schema, max_files=1).withColumn("event_time", T.event_time("timestamp"))

    def sky(temp):
        return '{"main":{"temp":%s}}' % temp

    def air(pm):
        return '{"list":[{"main":{"aqi":2},"components":{"pm2_5":%s}}]}' % pm
    weather = files("weather", [[("a", 10, 1, sky(10))], [("a", 50, 2, sky(20)), ("a", 70, 3, sky(30)), ("b", 20, 4, sky(40)), (None, 20, 5, sky(50))], [("z", 900, 9, sky(0))]])
    pollution = files("air", [[("a", 20, 8, air(1)), ("a", 30, 7, air(2)), ("b", 55, 1, "{}"), (None, 20, 2, air(3))], [("a", 75, 3, air(4)), ("c", 70, 3, air(5))], [("z", 901, 9, air(0))]])
    out, chk = T.fresh_dirs(spark, "t1-join")
    T.run_to_parquet(T.stream_combine_payloads(weather, pollution), out, chk)
    got = {(r.city, int((r.timestamp - START).total_seconds() // 60)): (r.temperature, r.pm2_5, r.visibility) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 20): (20.0, 1.0, 10000.0), ("a", 75): (30.0, 4.0, 10000.0), ("b", 55): (40.0, None, 10000.0)}


def test_upsert_stream_is_replay_safe(spark):
    src, schema = _split_events(spark, parts=2)
    stream = T.readings_stream(T.event_stream(spark, src, schema, max_files=1)).select(
        "city", "timestamp", "aqi")
    out, chk = T.fresh_dirs(spark, "t1-test")
    T.stream_ingest_upsert(stream, out, ["city", "timestamp"], chk)
    n1 = spark.read.parquet(out).count()
    # a second run with a fresh checkpoint replays every batch into the same store
    T.stream_ingest_upsert(T.readings_stream(T.event_stream(spark, src, schema, max_files=1)).select(
        "city", "timestamp", "aqi"), out, ["city", "timestamp"], chk + "-replay")
    assert spark.read.parquet(out).count() == n1 == table(spark, SF001, "events").count()


def test_hourly_mean_stream_emits_closed_windows_across_batches(spark):
    src, schema = _split_events(spark, parts=3)
    stream = T.readings_stream(T.event_stream(spark, src, schema, max_files=1))
    out, chk = T.fresh_dirs(spark, "t2-test")
    T.run_to_parquet(T.stream_hourly_mean(stream), out, chk)
    got = {(r["city"], r["hour_start"]): (r["n"], r["aqi_mean"]) for r in spark.read.parquet(out).collect()}
    rd = readings_from_events(table(spark, SF001, "events"))
    newest = rd.agg(F.max("timestamp")).first()[0]
    batch = (rd.groupBy("city", F.date_trunc("hour", "timestamp").alias("h"))
               .agg(F.count(F.lit(1)).alias("n"), F.avg("aqi").alias("m")).collect())
    closed = {(r["city"], r["h"]): (r["n"], r["m"]) for r in batch
              if r["h"] + dt.timedelta(hours=1) <= newest - dt.timedelta(hours=2)}
    assert set(closed) <= set(got)
    for k, (n, m) in closed.items():
        assert got[k][0] == n and abs(got[k][1] - m) < 1e-9
