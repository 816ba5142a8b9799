"""Reach and performance by ship length: as-of length, bands, weighted medians, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates

DAY_NS, JST_NS = 86_400 * rates.NS, 9 * 3600 * rates.NS


def day_end_ns(day: str = "day"):
    """First instant after a JST day."""
    return (F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("bigint") + 1) * DAY_NS - JST_NS


def with_length(days: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add the latest non-null length valid before the end of the row's JST day; ``days(day, mmsi, ...)``.

    Versions and days are merged into one ordered stream per vessel, so there is no join on a time range.
    """
    known = lengths.where("ship_length_m is not null").select("mmsi", F.col("valid_from").alias("at"), F.lit(0).alias("is_day"), F.col("ship_length_m").alias("known"), F.lit(None).cast("date").alias("day"))
    asked = days.select("mmsi", "day").distinct().select("mmsi", day_end_ns().alias("at"), F.lit(-1).alias("is_day"), F.lit(None).cast("int").alias("known"), "day")
    w = Window.partitionBy("mmsi").orderBy("at", "is_day").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(known).withColumn("ship_length_m", F.last("known", ignorenulls=True).over(w)).where("day is not null").select("mmsi", "day", "ship_length_m")
    return days.join(found, ["mmsi", "day"]).withColumn("length_band", F.expr(rates.length_band("ship_length_m")))


def reach(presence_days: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per length band: vessels, vessel-days, mean and median lower edge of the farthest band, share beyond 30 and 50 km."""
    far = presence_days.groupBy("day", "vessel_class", "mmsi").agg(F.max("band").alias("band"))
    df = with_length(far, lengths).withColumn("km", F.col("band") * geo.BAND_KM)
    w = Window.partitionBy("length_band").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    cells = df.groupBy("length_band", "band").agg(F.count("*").alias("n"))
    total = Window.partitionBy("length_band")
    cells = cells.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(total))
    median = cells.where(F.col("upto") >= (F.col("all") + 1) / 2).groupBy("length_band").agg(F.min("band").alias("median_band"))
    sums = df.groupBy("length_band").agg(F.countDistinct("mmsi").alias("vessels"), F.count("*").alias("vessel_days"), F.avg("km").alias("mean_km"), F.count_if(F.col("km") >= 30).alias("beyond_30"), F.count_if(F.col("km") >= 50).alias("beyond_50"))
    out = sums.join(median, "length_band")
    return out.withColumns({"pct_30": F.col("beyond_30") * 100.0 / F.col("vessel_days"), "pct_50": F.col("beyond_50") * 100.0 / F.col("vessel_days"), "sufficient": (F.col("vessel_days") >= 30) & (F.col("vessels") >= 3)})


def performance(vessel_days: DataFrame, lengths: DataFrame) -> DataFrame:
    """Losses and staleness by length band, distance band and class."""
    df = with_length(vessel_days, lengths)
    out = df.groupBy("length_band", "band", "vessel_class").agg(*[F.sum(m).alias(m) for m in ("observed", "missing", "observed_s", "stale_s")], F.countDistinct("mmsi").alias("vessels"), F.countDistinct("day").alias("days"))
    return out.withColumns({"loss_pct": F.expr(rates.percent("missing", "observed + missing")), "stale_pct": F.expr(rates.percent("stale_s", "observed_s"))})


def coverage(presence_days: DataFrame, lengths: DataFrame) -> DataFrame:
    """Days, vessels and vessel-days, and how many have a known length."""
    df = with_length(presence_days.select("day", "vessel_class", "mmsi").distinct(), lengths)
    known = F.col("length_band") < 6
    return df.agg(F.countDistinct("day").alias("days"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct(F.when(known, F.col("mmsi"))).alias("known_vessels"), F.count("*").alias("vessel_days"), F.count_if(known).alias("known_vessel_days"))


def daily_quality(facts: DataFrame, diagnostics: DataFrame, vessels: DataFrame, first: str, last: str) -> DataFrame:
    """State of every calendar day from first to last.

    ``facts(day, bucket)``, ``diagnostics(day, code, n)``, ``vessels(day, mmsi)``.
    """
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    buckets = facts.groupBy("day").agg(F.countDistinct("bucket").alias("buckets"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0))
    codes = diagnostics.groupBy("day").agg(of("ACCEPTED").alias("accepted"), of("SOURCE_READ_FAILED").alias("failures"), F.coalesce(F.sum(F.when(F.col("code").startswith("INTERVAL"), F.col("n"))), F.lit(0)).alias("excluded"))
    seen = vessels.groupBy("day").agg(F.countDistinct("mmsi").alias("vessels"))
    df = spine.join(buckets, "day", "left").join(codes, "day", "left").join(seen, "day", "left").fillna(0, ["accepted", "failures", "excluded", "vessels"])
    state = (
        F.when(F.col("buckets").isNull(), "NOT_ANALYZED").when((F.col("failures") > 0) | (F.col("accepted") == 0) | (F.col("buckets") <= 275) | (F.col("buckets") > 288), "REVIEW_REQUIRED")
        .when(F.col("buckets") == 288, "ALL_BUCKETS_PRESENT").otherwise("PARTIAL")
    )
    return df.withColumn("state", state)
