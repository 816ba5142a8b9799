"""Position reports derived from the generic event stream, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.steps import Steps, with_steps

BASE_US = 1_704_067_200_000_000

#: Columns of a report from (event_id, user_id, us): valid in Spark and in ANSI SQL.
REPORT_STEPS: Steps = [
    ("vessel", "CAST(user_id % 25 AS INT)"),
    ("mmsi", "CAST(431000000 + vessel AS INT)"),
    ("vessel_class", "CASE WHEN vessel % 5 = 0 THEN 'B' ELSE 'A' END"),
    ("class_b_mode", "CASE WHEN vessel % 10 = 0 THEN 'CARRIER_SENSE' ELSE 'SELF_ORGANIZING' END"),
    ("t_us", f"CAST({BASE_US} + floor((us - {BASE_US}) / 5e0) AS BIGINT)"),
    ("ts_ns", "t_us * 1000"),
    ("minute", "CAST(floor(t_us / 60000000e0) AS BIGINT)"),
    ("message_type", "CASE WHEN vessel % 5 = 0 THEN 18 ELSE CAST(1 + event_id % 3 AS INT) END"),
    ("sog", "CAST(event_id * 7 % 300 AS DOUBLE) / 10e0"),
    ("cog", "CAST(event_id * 13 % 3600 AS DOUBLE) / 10e0"),
    ("heading", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id * 17 % 360 AS DOUBLE) END"),
    ("nav_status", "CASE WHEN vessel % 5 = 0 THEN NULL ELSE CAST(event_id % 16 AS INT) END"),
    ("lat", "CAST(34300000 + vessel * 30000 - CASE WHEN vessel = 24 THEN 1200000 ELSE 0 END + (minute % 120 - 60) * 500 + CASE WHEN event_id % 97 = 0 THEN 500000 ELSE 0 END AS DOUBLE) / 1000000e0"),
    ("lon", "CAST(134900000 + vessel * 7 % 25 * 35000 + (minute * 3 % 160 - 80) * 500 AS DOUBLE) / 1000000e0"),
]
COLUMNS = ["event_id", "mmsi", "vessel_class", "class_b_mode", "ts_ns", "message_type", "sog", "cog", "heading", "nav_status", "lat", "lon"]


def reports_of_events(events: DataFrame) -> DataFrame:
    us = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return with_steps(us, REPORT_STEPS).select(*COLUMNS, F.col("event_id").alias("seq"))
