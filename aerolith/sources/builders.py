"""Nested payloads built in-query from ``events`` rows (to exercise S5 / S6 / J1 at volume).

Optional fields are left null, which ``to_json`` omits from the document, so the
decoders see genuinely absent keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weather_payloads(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    doc = F.struct(
        F.struct(F.lit(24.86).alias("lat"), F.lit(67.01).alias("lon")).alias("coord"),
        F.struct((uid % 45).cast("double").alias("temp"), (uid % 100).cast("double").alias("humidity"),
                 (uid % 40 + 990).cast("double").alias("pressure")).alias("main"),
        F.struct((eid % 13).cast("double").alias("speed"),
                 F.when(eid % 3 != 0, ((eid * 7) % 360).cast("double")).alias("deg")).alias("wind"),
        F.array(F.struct(F.col("event_type").alias("main"),
                         F.concat(F.col("event_type"), F.lit(" sky")).alias("description"))).alias("weather"),
        F.struct((uid % 100).cast("double").alias("all")).alias("clouds"),
        F.when(eid % 4 != 0, ((eid % 50) * 200).cast("double")).alias("visibility"),
    )
    return events.select(F.col("event_type").alias("city"), F.col("ts").alias("timestamp"), "event_id",
                         F.to_json(doc).alias("payload"))


def air_payloads(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    comp = F.struct(((eid % 97) / 10.0).alias("co"), (uid % 9).cast("double").alias("no"),
                    ((eid * 7) % 60).cast("double").alias("no2"), ((eid + uid) % 80).cast("double").alias("o3"),
                    (uid % 20).cast("double").alias("so2"),
                    F.get_json_object("props", "$.k").cast("double").alias("pm2_5"),
                    (F.get_json_object("props", "$.k").cast("double") * 1.5).alias("pm10"),
                    (uid % 5).cast("double").alias("nh3"))
    item = F.struct(F.struct((F.floor(F.col("value") / 100) + 1).cast("int").alias("aqi")).alias("main"),
                    comp.alias("components"))
    lst = F.when(eid % 11 != 0, F.array(item)).otherwise(F.array_remove(F.array(item), item))
    return events.select(F.col("event_type").alias("city"), F.col("ts").alias("timestamp"), "event_id",
                         F.to_json(F.struct(lst.alias("list"))).alias("payload"))
