"""Registered streaming queries: each runs a Structured Streaming query to completion
(``availableNow``) over the events file and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.plans.registry import READINGS_CTE, d, finish, i, register, ts
from aerolith.streaming import streams as T
from aerolith.sources.builders import air_payloads, weather_payloads
from aerolith.sources.testdata import table


def _stream(spark, sf):
    # a glob, so the file source treats the single file as one input among a folder's files
    src = f"{sf.rstrip('/')}/events*.parquet"
    schema = table(spark, sf, "events").schema
    return T.readings_stream(T.event_stream(spark, src, schema))


def _in_batches(spark, sf, build=lambda events: events, late="0"):
    """``build(events)`` as a stream of three micro-batches of several files each: thirds of the days, every row
    coming ``late`` minutes after its time (so that it may come in the next batch)."""
    events = table(spark, sf, "events")
    src, _ = T.fresh_dirs(spark, "batches")
    span = events.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).first()
    came = F.to_date(F.col("ts") + F.make_dt_interval(mins=F.expr(late)))
    third = F.least(F.lit(2), F.floor(F.date_diff(came, F.lit(span.lo)) * 3 / F.lit((span.hi - span.lo).days + 1))).cast("int")
    made = build(events.withColumn("__third", third))
    for k in range(3):  # one batch after the other: the source reads files in the order of their age
        made.filter(F.col("__third") == k).drop("__third").repartition(FILES).write.mode("append").parquet(src)
    return T.event_stream(spark, src, made.drop("__third").schema, max_files=FILES)


FILES = 4  # files of a micro-batch
_LATE = "CASE WHEN event_id % 5 = 0 THEN 90 ELSE 0 END"  # minutes; within the two hours of the watermark


def _payloads(make):
    """Raw documents of the events (a stand-in for the collector's files) with the batch they come in."""
    def build(events):
        return make(events).join(events.select("event_id", "__third"), "event_id")
    return build


def _with_event_time(stream):
    return stream.withColumn("event_time", T.event_time("timestamp"))


@register("t2_stream_hourly_mean", f"""WITH {READINGS_CTE},
h AS (SELECT city, date_trunc('hour', "timestamp") AS hour_start, avg(aqi) AS aqi_mean, count(*) AS n FROM readings GROUP BY 1, 2)
SELECT city, {ts('hour_start', 'hour_start')}, {d('aqi_mean', 'aqi_mean')}, {i('n', 'n')} FROM h
WHERE hour_start + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM readings) - INTERVAL 2 HOUR""")
def q_t2(spark, sf):
    out, chk = T.fresh_dirs(spark, "t2")
    T.run_to_parquet(T.stream_hourly_mean(_stream(spark, sf)), out, chk)
    return finish(spark.read.parquet(out))


@register("t3_stream_dedupe", f"""WITH {READINGS_CTE}
SELECT city, {ts('"timestamp"', '"timestamp"')} FROM (SELECT DISTINCT city, "timestamp" FROM readings)""")
def q_t3(spark, sf):
    out, chk = T.fresh_dirs(spark, "t3")
    T.run_to_parquet(T.stream_dedupe(_stream(spark, sf)).select("city", "timestamp"), out, chk)
    return finish(spark.read.parquet(out))


# rows that the watermark has passed: two hours behind the newest event, to the millisecond
_PASSED = "date_trunc('millisecond', \"timestamp\") < date_trunc('millisecond', (SELECT max(\"timestamp\") FROM readings)) - INTERVAL 2 HOUR"


@register("t4_stream_change_rate", f"""WITH {READINGS_CTE.replace('SELECT event_type AS city', 'SELECT event_id, event_type AS city')},
f AS (SELECT *, coalesce(aqi - lag(aqi, 1) OVER w, 0) AS rate, coalesce(avg(aqi) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), aqi) AS ma
      FROM readings WINDOW w AS (PARTITION BY city ORDER BY "timestamp", event_id))
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('aqi', 'aqi')}, {d('rate', 'aqi_change_rate')}, {d('ma', 'aqi_ma_3h')} FROM f WHERE {_PASSED}""")
def q_t4(spark, sf):
    out, chk = T.fresh_dirs(spark, "t4")
    events = _in_batches(spark, sf, late=_LATE)
    T.run_to_parquet(T.stream_change_rate(T.readings_stream(events, extra=["event_id"]), tie="event_id"), out, chk)
    return finish(spark.read.parquet(out))


@register("t1_stream_ingest_upsert", f"""WITH w AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS hour_ts, arg_max(event_id, ts) AS w_id FROM events GROUP BY 1, 2),
a AS (SELECT event_type AS city, date_trunc('hour', ts) AS hour_ts, arg_max(event_id, event_id) AS a_id FROM events GROUP BY 1, 2),
j AS (SELECT w.city, w.hour_ts, ea.ts AS "timestamp", ew.user_id % 45 AS temperature, ew.user_id % 100 AS humidity,
             CASE WHEN ea.event_id % 11 <> 0 THEN floor(ea.value / 100) + 1 END AS aqi,
             CASE WHEN ea.event_id % 11 <> 0 THEN CAST(json_extract_string(ea.props, '$.k') AS DOUBLE) END AS pm2_5,
             w.hour_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS closed
      FROM w JOIN a ON a.city = w.city AND a.hour_ts = w.hour_ts JOIN events ew ON ew.event_id = w.w_id JOIN events ea ON ea.event_id = a.a_id)
SELECT city, {ts('"timestamp"', '"timestamp"')}, {d('CASE WHEN closed THEN aqi END', 'aqi')}, {d('CASE WHEN closed THEN pm2_5 ELSE -1 END', 'pm2_5')},
       {d('CASE WHEN closed THEN temperature ELSE -1 END', 'temperature')}, {d('CASE WHEN closed THEN humidity ELSE -1 END', 'humidity')} FROM j""")
def q_t1(spark, sf):
    """Weather and air files, the weather side late, into a store that holds older readings of the same hours."""
    from aerolith.operators.joins import combine_weather_air
    from aerolith.sources.store import write_readings
    store, chk = T.fresh_dirs(spark, "t1")
    ev, cols = table(spark, sf, "events"), ["city", "timestamp", "aqi", "pm2_5", "temperature", "humidity"]
    sides = [make(ev).select("city", "timestamp", "event_id") for make in (weather_payloads, air_payloads)]
    older = combine_weather_air(*sides, weather_order="timestamp", air_order="event_id").select("city", "timestamp")
    write_readings(older.select("city", "timestamp", F.lit(None).cast("double").alias("aqi"), *[F.lit(-1.0).alias(c) for c in cols[3:]]), store)
    weather = _with_event_time(_in_batches(spark, sf, _payloads(weather_payloads), late=_LATE))
    air = _with_event_time(_in_batches(spark, sf, _payloads(air_payloads)))
    T.stream_ingest_upsert(T.stream_combine_payloads(weather, air).select(*cols), store, ["city", "timestamp"], chk)
    return finish(spark.read.parquet(store).select(*cols))


_T5 = f"""{READINGS_CTE.replace('SELECT event_type AS city', 'SELECT event_id, event_type AS city')},
span AS (SELECT min(CAST("timestamp" AS DATE)) AS lo, max(CAST("timestamp" AS DATE)) AS hi FROM readings),
b AS (SELECT readings.*, CAST(floor((CAST("timestamp" AS DATE) - lo) * 3 / (hi - lo + 1)) AS INTEGER) AS batch FROM readings, span),
k AS (SELECT unnest([0, 1, 2]) AS batch_id),
l AS (SELECT batch_id, city, max("timestamp") AS last_seen, max("timestamp") FILTER (WHERE batch = batch_id) AS own FROM b, k WHERE batch <= batch_id GROUP BY 1, 2),
m AS (SELECT batch_id, date_trunc('millisecond', max(last_seen)) AS mark FROM l GROUP BY 1),
s AS (SELECT city, last_seen, false AS silent FROM l WHERE own = last_seen
      UNION ALL SELECT DISTINCT city, last_seen, true FROM l JOIN m USING (batch_id)
      WHERE last_seen + INTERVAL 10 MINUTE < mark)"""


@register("t5_stream_freshness", f"""WITH {_T5} SELECT city, {ts('last_seen', 'last_seen')}, silent FROM s""")
def q_t5(spark, sf):
    out, chk = T.fresh_dirs(spark, "t5")
    T.run_to_parquet(T.stream_freshness(T.readings_stream(_in_batches(spark, sf)), silent_hours=1 / 6), out, chk)
    return finish(spark.read.parquet(out))
