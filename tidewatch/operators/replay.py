"""Replay of a day: the display state of all vessels at any time, without reading the day up to it.

``ReplayIndex`` keeps the analysed reports by hour and, for each hour, the last state before it of every vessel seen that day. A seek
reads that table's hour and the reports of this hour and the one before (whose points are still in the trail), forward or backward
alike. ``advanced`` takes a state forward by the reports in between; it equals a seek to the same time.

A day starts without states: its reports are analysed apart from other days (JST).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates
from tidewatch.operators import cube, intervals
from tidewatch.sources.work import saved

NS, HOUR_NS = rates.NS, 3600 * rates.NS
VISIBLE_S, TRAIL_S = 600, 3600
DECIDES_NS = 2 * intervals.HISTORY_NS + intervals.RELEASE_NS + NS
#: What is kept of a vessel's latest report.
STATE = ["ts_ns", "seq", "vessel_class", "lat", "lon", "heading", "cog", "expected_here"]


def _hour(ns: Column) -> Column:
    """Number of the hour; whole hours divide exactly, times as doubles don't."""
    return F.floor((ns - F.pmod(ns, F.lit(HOUR_NS))) / HOUR_NS)


def by_day(reports: DataFrame) -> DataFrame:
    """Analysed reports (``STATE``, day, mmsi), each day on its own."""
    df = reports.withColumn("mmsi", F.struct(cube.jst_day(F.col("ts_ns")).alias("day"), "mmsi"))
    return intervals.analyzed(df).select("mmsi.day", "mmsi.mmsi", *STATE)


def latest(rows: DataFrame) -> DataFrame:
    """Of each vessel the last state by (time, sequence)."""
    return rows.groupBy("mmsi").agg(F.max_by(F.struct(*STATE), F.struct("ts_ns", "seq")).alias("s")).select("mmsi", "s.*")


def advanced(states: DataFrame, reports: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """States at ``to_ns`` from those at ``from_ns``; ``reports`` are analysed ones, of which those in between are read."""
    more = reports.where((F.col("ts_ns") > from_ns) & (F.col("ts_ns") <= to_ns)).select("mmsi", *STATE)
    return latest(states.select("mmsi", *STATE).unionByName(more))


def states_at(reports: DataFrame, at_ns: int) -> DataFrame:
    """``latest`` of the analysed reports up to a time, of which only each vessel's last ones are analysed.

    A report is turning by reports of the last ``DECIDES_NS`` alone: a slow one turns within 20 s of the first after the turn's last quick one, which is at most 30 s
    earlier and judged by 30 s of history. Whether an interval is excluded hangs on the report before it of the same class, so the last one before that stretch is read, too.
    """
    past = reports.where(F.col("ts_ns") <= at_ns)

    def beside(df: DataFrame, known: DataFrame, keys: list[str], how: str) -> DataFrame:
        own = known.withColumnsRenamed({k: f"{k}_" for k in keys})
        return df.join(own, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], how).drop(*[f"{k}_" for k in keys])

    ends = saved(past.groupBy("mmsi").agg((F.max("ts_ns") - DECIDES_NS).alias("from_ns")), "last-times")
    placed = beside(past, ends, ["mmsi"], "inner")
    early = saved(placed.where("ts_ns < from_ns").groupBy("mmsi", "vessel_class").agg(F.max("ts_ns").alias("early_ns")), "last-times")
    near = beside(placed, early, ["mmsi", "vessel_class"], "left").where("ts_ns >= from_ns OR ts_ns = early_ns").drop("from_ns", "early_ns")
    return latest(intervals.analyzed(near).select("mmsi", *STATE))


def trails(reports: DataFrame, at_ns: int, trail_s: int = TRAIL_S) -> DataFrame:
    """Points of each vessel in the last ``trail_s`` seconds, in order."""
    near = reports.where((F.col("ts_ns") >= at_ns - trail_s * NS) & (F.col("ts_ns") <= at_ns))
    return near.groupBy("mmsi").agg(F.array_sort(F.collect_list(F.struct("ts_ns", "seq", "lat", "lon"))).alias("trail"))


def displayed(states: DataFrame, trail: DataFrame, at_ns: int, classes: tuple[str, ...] = ("A", "B"), visible_s: int = VISIBLE_S) -> DataFrame:
    """What is shown of each vessel; the class filter looks at its latest report."""
    df = states.where(F.col("vessel_class").isin(*classes)).join(trail, "mmsi", "left").withColumn("age_s", (F.lit(at_ns) - F.col("ts_ns")) / float(NS))
    direction = F.coalesce("heading", "cog").alias("direction")
    points = F.coalesce("trail", F.array().cast("array<struct<ts_ns:bigint,seq:bigint,lat:double,lon:double>>"))
    return df.select("mmsi", "vessel_class", "lat", "lon", direction, "age_s", F.col("expected_here").alias("expected_s"), F.expr(rates.freshness_state("age_s", "expected_here")).alias("state"), (F.col("age_s") < visible_s).alias("visible"), points.alias("trail"))


def detailed(shown: DataFrame) -> DataFrame:
    """``displayed`` vessels with their distance to the receiver."""
    return shown.withColumn("km", F.expr(geo.receiver_km("lat", "lon")))


class ReplayIndex:
    """Tables under ``path``: ``rows/hour=`` and ``before/hour=``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, reports: DataFrame) -> None:
        rows = by_day(reports).withColumn("hour", _hour(F.col("ts_ns")))
        rows.hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/rows")
        last = self.spark.read.parquet(f"{self.path}/rows").groupBy("day", "mmsi", "hour").agg(F.max_by(F.struct(*STATE), F.struct("ts_ns", "seq")).alias("s"))
        following = F.lead("hour").over(Window.partitionBy("day", "mmsi").orderBy("hour"))
        # the last hour of the day; hours and days meet, since the zone is a whole number of hours away
        end = F.floor(((F.datediff("day", F.lit("1970-01-01").cast("date")) + 1) * (cube.DAY_NS // HOUR_NS) - cube.JST_NS // HOUR_NS) - 1)
        until = F.least(F.coalesce(following, end), end)
        held = last.withColumn("until", until).where(F.col("hour") < F.col("until")).withColumn("hour", F.explode(F.sequence(F.col("hour") + 1, F.col("until"))))
        held.select("day", "mmsi", "s.*", "hour").hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/before")

    def _read(self, table: str, at_ns: int, hours: list[int]) -> DataFrame:
        day = cube.jst_day(F.lit(at_ns))
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("hour").isin(hours) & (F.col("day") == day)).drop("hour", "day")

    def rows(self, at_ns: int) -> DataFrame:
        """Reports up to a time out of its hour and the one before."""
        hour = at_ns // HOUR_NS
        return self._read("rows", at_ns, [hour - 1, hour]).where(F.col("ts_ns") <= at_ns)

    def states(self, at_ns: int) -> DataFrame:
        before = self._read("before", at_ns, [at_ns // HOUR_NS])
        return latest(before.select("mmsi", *STATE).unionByName(self.rows(at_ns).where(F.col("ts_ns") >= at_ns // HOUR_NS * HOUR_NS).select("mmsi", *STATE)))

    def seek(self, at_ns: int, classes: tuple[str, ...] = ("A", "B"), visible_s: int = VISIBLE_S, trail_s: int = TRAIL_S) -> DataFrame:
        """``displayed`` at any time; trails reach back an hour at most."""
        if not 0 <= trail_s <= TRAIL_S:
            raise ValueError("a trail is at most an hour long")
        return displayed(self.states(at_ns), trails(self.rows(at_ns), at_ns, trail_s), at_ns, classes, visible_s)
