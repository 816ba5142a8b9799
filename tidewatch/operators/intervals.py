"""Interval engine: pairing, exclusion, course-change automaton, expected interval, losses, staleness.

Reports are dealt by vessel once; all windows partition by the vessel and more, so that one shuffle serves them. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates

NS = rates.NS
HISTORY_NS, RELEASE_NS, TURN_DEGREES, COG_LEAST_KN = 30 * NS, 20 * NS, 5.0, 2.0


def paired(reports: DataFrame, dealt: bool = False) -> DataFrame:
    """Each report with the one before it of the same vessel and class, and why that interval doesn't count.

    Where there is a column ``boundary``, its rows begin anew after a simulated stretch out of the model. ``dealt``: the reports are dealt by ``mmsi`` already.
    """
    w = Window.partitionBy("mmsi", "vessel_class").orderBy("ts_ns", "seq")
    # dealt before the first window asks for (mmsi, vessel_class), whose order wouldn't serve those that ask for mmsi alone
    df = (reports if dealt else reports.repartition("mmsi")).withColumn("km", F.expr(geo.receiver_km("lat", "lon")))
    before = F.lag(F.struct("ts_ns", "lat", "lon", "km")).over(w)
    df = df.withColumn("before", before).withColumn("delta_ns", F.col("ts_ns") - F.col("before.ts_ns"))
    df = df.withColumn("reason", F.expr(rates.exclusion("delta_ns", "before.km", "km", "lat", "lon", "before.lat", "before.lon")))
    return df.withColumn("reason", F.when(F.col("boundary"), "SIMULATION_OUT_OF_MODEL_BOUNDARY").otherwise(F.col("reason"))) if "boundary" in df.columns else df


def with_course(df: DataFrame, scope: tuple[str, ...] = ("mmsi",)) -> DataFrame:
    """Add ``turning``. The history is cut where an interval was excluded, FIRST_REPORT apart."""
    cut = F.when(F.col("reason").isNotNull() & (F.col("reason") != "FIRST_REPORT"), 1).otherwise(0)
    df = df.withColumn("segment", F.sum(cut).over(Window.partitionBy(*scope).orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    key = [*scope, "segment"]
    past = Window.partitionBy(*key).orderBy("ts_ns").rangeBetween(-HISTORY_NS, -1)
    peers = Window.partitionBy(*key, "ts_ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = {"h": F.col("heading"), "c": F.when(F.col("sog") > COG_LEAST_KN, F.col("cog"))}

    def total(x):
        return F.coalesce(F.sum(x).over(past), F.lit(0.0)) + F.coalesce(F.sum(x).over(peers), F.lit(0.0))

    for k, direction in own.items():
        df = df.withColumns({f"{k}_s": total(F.sin(F.radians(direction))), f"{k}_c": total(F.cos(F.radians(direction))), f"{k}_n": F.count(direction).over(past) + F.count(direction).over(peers)})
    by_heading = F.col("heading").isNotNull()
    pick = {c: F.when(by_heading, F.col(f"h_{c}")).otherwise(F.col(f"c_{c}")) for c in "scn"}
    direction = F.coalesce(own["h"], own["c"])
    mean = F.degrees(F.atan2(pick["s"], pick["c"]))
    apart = F.abs(F.pmod(direction - mean + 540, F.lit(360.0)) - 180)
    silent = (F.col("vessel_class") == "B") & (F.col("class_b_mode") == "CARRIER_SENSE")
    kind = F.when(silent | direction.isNull() | (pick["n"] == 0), "R").when(F.round(apart, 9) > TURN_DEGREES, "H").otherwise("L")
    order = Window.partitionBy(*key).orderBy("ts_ns", "seq")
    df = df.withColumn("kind", kind).withColumn("run", F.sum(F.when(F.col("kind") != "L", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*key, "run")
    anchor = F.max(F.when(F.col("kind") != "L", F.col("kind"))).over(whole)
    low_since = F.min(F.when(F.col("kind") == "L", F.col("ts_ns"))).over(whole)
    turning = (anchor == "H") & ((F.col("kind") == "H") | (F.col("ts_ns") - low_since <= RELEASE_NS))
    return df.withColumn("turning", F.coalesce(turning, F.lit(False))).drop(*[f"{k}_{c}" for k in own for c in "scn"], "run")


def analyzed(reports: DataFrame, scope: tuple[str, ...] = ("mmsi",), dealt: bool = False) -> DataFrame:
    """One row per report after the first of its vessel and class: the interval that ends there.

    ``reason`` is null for accepted intervals; the expected interval is that of the start row.
    """
    df = with_course(paired(reports, dealt), scope).withColumn("expected_here", F.expr(rates.expected_seconds()))
    w = Window.partitionBy("mmsi", "vessel_class").orderBy("ts_ns", "seq")
    start = F.lag(F.struct("ts_ns", "seq", "lat", "lon", "km", "turning", F.col("expected_here").alias("expected_s"))).over(w)
    df = df.withColumn("start", start).withColumn("actual_s", F.col("delta_ns") / float(NS))
    ok = F.col("reason").isNull()
    df = df.withColumn("expected_s", F.col("start.expected_s")).withColumn("missing", F.when(ok, F.expr(rates.losses("actual_s", "expected_s"))))
    limit = rates.STALE_FACTOR * F.col("expected_s")
    return df.withColumns({
        "start_ns": F.col("start.ts_ns"), "start_lat": F.col("start.lat"), "start_lon": F.col("start.lon"), "start_km": F.col("start.km"),
        "stale_start_ns": F.when(ok, F.col("start.ts_ns") + F.floor(limit * NS + 0.5).cast("bigint")), "stale_s": F.when(ok, F.greatest(F.lit(0.0), F.col("actual_s") - limit)),
    }).drop("start", "before")


def accepted(reports: DataFrame) -> DataFrame:
    return analyzed(reports).where(F.col("reason").isNull())


def run_summary(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.count("*").alias("reports"))


def exclusion_counts(intervals: DataFrame) -> DataFrame:
    return intervals.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
