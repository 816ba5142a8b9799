"""Vessel metadata: merging of updates, versions with validity, as-of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("imo", "call_sign", "vessel_name", "ship_type", "destination", "ship_length_m")


def merged(updates: DataFrame) -> DataFrame:
    """State of each vessel after each update: a newer non-null field wins; an UNKNOWN class doesn't."""
    w = Window.partitionBy("mmsi").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("vessel_class") != "UNKNOWN", F.col("vessel_class"))
    have = [c for c in FIELDS if c in updates.columns]
    return updates.select("mmsi", "ts_ns", "seq", F.coalesce(F.last(known, ignorenulls=True).over(w), F.lit("UNKNOWN")).alias("vessel_class"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in have])


def versions(states: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Slowly changing history: the last state of an instant, only where something changed; valid_to null while current."""
    have = ["vessel_class", *[c for c in fields if c in states.columns]]
    last = states.groupBy("mmsi", "ts_ns").agg(F.max_by(F.struct(*have), "seq").alias("state"))
    w = Window.partitionBy("mmsi").orderBy("ts_ns")
    changed = last.withColumn("was", F.lag("state").over(w)).where(F.col("was").isNull() | ~F.col("state").eqNullSafe(F.col("was")))
    return changed.select("mmsi", F.col("ts_ns").alias("valid_from"), F.lead("ts_ns").over(w).alias("valid_to"), "state.*")


def effective(history: DataFrame, at: DataFrame) -> DataFrame:
    """Version of each (mmsi, at_ns) that was valid then; rows without one keep nulls. Versions of a vessel don't overlap.

    Versions and rows are merged into one ordered stream per vessel, so there is no join on a time range.
    """
    shown = [c for c in history.columns if c not in ("mmsi", *at.columns)]
    known = history.where("mmsi is not null").select("mmsi", F.col("valid_from").alias("at_ns"), F.lit(0).alias("is_row"), F.struct("valid_to", *[c for c in shown if c != "valid_to"]).alias("version"))
    asked = at.select("mmsi", "at_ns", F.lit(1).alias("is_row"), F.struct(*at.columns).alias("row"))
    w = Window.partitionBy("mmsi").orderBy("at_ns", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(known, allowMissingColumns=True).withColumn("version", F.last("version", ignorenulls=True).over(w)).where("is_row = 1")
    valid = F.col("version.valid_to").isNull() | (F.col("at_ns") < F.col("version.valid_to"))
    return found.select("row.*", *[F.when(valid, F.col(f"version.{c}")).alias(c) for c in shown])


def first_known_length(updates: DataFrame) -> DataFrame:
    """The first positive length that each vessel reported."""
    return updates.where("ship_length_m > 0").groupBy("mmsi").agg(F.min_by("ship_length_m", F.struct("ts_ns", "seq")).alias("ship_length_m"))
