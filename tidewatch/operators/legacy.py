"""The older statistics: category intervals, ten-kilometre bins, vessel totals, and the research tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates
from tidewatch.operators.cube import jst_day

NS = rates.NS
BIN_KM, LEAST_MESSAGES = 10, {1: 100, 5: 10, 18: 100}


def category(message_type: Column) -> Column:
    return F.when(message_type.isin(1, 2, 3), 1).when(message_type.isin(5, 18), message_type)


def category_intervals(reports: DataFrame, gap_multiplier: int = 10) -> DataFrame:
    """Accepted intervals by vessel and category. ``reports`` has ``expected_here`` (seconds) and ``km``; type 5 takes 360 s."""
    w = Window.partitionBy("mmsi", "category").orderBy("ts_ns", "seq")
    df = reports.withColumn("category", category(F.col("message_type"))).where("category is not null")
    df = df.withColumn("own_s", F.when(F.col("category") == 5, F.lit(360.0)).otherwise(F.col("expected_here")))
    df = df.withColumn("start", F.lag(F.struct("ts_ns", "km", "own_s")).over(w))
    df = df.withColumn("actual_s", (F.col("ts_ns") - F.col("start.ts_ns")) / float(NS)).where("start is not null and actual_s >= 0")
    df = df.where((F.col("actual_s") < F.expr(rates.legacy_gap_seconds("category", gap_multiplier))) & F.coalesce(F.abs(F.col("km") - F.col("start.km")) <= rates.JUMP_KM, F.lit(True)))
    return df.withColumn("loss", F.expr(rates.losses("actual_s", "start.own_s"))).withColumn("start_km", F.col("start.km")).withColumn("start_day", jst_day(F.col("start.ts_ns"))).drop("start")


def static_positions(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Static reports with the latest position of that vessel at or before them."""
    both = static.select("mmsi", "ts_ns", "seq", F.lit(1).alias("is_static"), F.lit(None).cast("double").alias("km")).union(dynamic.select("mmsi", "ts_ns", "seq", F.lit(0), "km"))
    w = Window.partitionBy("mmsi").orderBy("ts_ns", "is_static", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_km", F.last("km", ignorenulls=True).over(w)).where("is_static = 1").select("mmsi", "ts_ns", "seq", F.col("last_km").alias("km"))


def distance_bins(intervals: DataFrame, keys: tuple[str, ...] = ("mmsi", "category"), width: int = BIN_KM) -> DataFrame:
    df = intervals.where("start_km is not null").withColumn("bin", F.floor(F.col("start_km") / width).cast("int"))
    out = df.groupBy(*keys, "bin").agg(F.count("*").alias("observed"), F.sum("loss").alias("loss"), F.avg("start_km").alias("avg_km"))
    out = out.withColumn("expected", F.col("observed") + F.col("loss"))
    return out.withColumn("loss_pct", F.when(F.col("expected") > 0, F.col("loss") * 100.0 / F.col("expected")).otherwise(0.0))


def vessel_totals(intervals: DataFrame, least: int | dict[int, int] = 100) -> DataFrame:
    """Per vessel and category with at least ``least`` messages, the same for all categories or by category (``LEAST_MESSAGES``)."""
    df = intervals.groupBy("mmsi", "category").agg(
        F.count("*").alias("total"), F.sum("loss").alias("loss"), F.max(F.floor(F.col("actual_s") + 0.5)).cast("bigint").alias("max_s"), F.avg(F.floor(F.col("actual_s") + 0.5)).alias("avg_s"), F.max(F.when(F.col("loss") > 0, F.col("start_km"))).alias("max_lossy_km")
    )
    floor = F.lit(least) if isinstance(least, int) else F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("category")]
    return df.where(F.col("total") >= floor).withColumn("loss_pct", F.col("loss") * 100.0 / (F.col("total") + F.col("loss")))


def across_vessels(totals: DataFrame) -> DataFrame:
    return totals.groupBy("category").agg(F.count("*").alias("vessels"), F.avg("loss_pct").alias("mean_pct"), F.percentile("loss_pct", 0.5).alias("median_pct"), F.max("loss_pct").alias("max_pct"), F.max("max_lossy_km").alias("max_km"))


def gap_histogram(intervals: DataFrame, edges: tuple[int, ...] = (360, 539, 720, 1079, 1439, 1799, 2159, 3599)) -> DataFrame:
    bucket = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col("actual_s") <= edges[k], k).otherwise(bucket)
    return intervals.groupBy("category", bucket.alias("gap_bucket")).agg(F.count("*").alias("n"), F.percentile("actual_s", 0.5).alias("p50"), F.percentile("actual_s", 0.9).alias("p90"))


def interval_diagnostics(intervals: DataFrame) -> DataFrame:
    a = F.col("actual_s")
    return intervals.groupBy("category").agg(F.count("*").alias("n"), F.count_if(a == 0).alias("zero"), F.count_if(a < 0.5).alias("below_half"), F.sum("loss").alias("loss"), F.percentile("actual_s", 0.5).alias("p50"), F.percentile("actual_s", 0.75).alias("p75"), F.percentile("actual_s", 0.9).alias("p90"))


PERIOD_KEYS = {
    "YEAR": lambda d: F.date_format(d, "yyyy"), "MONTH": lambda d: F.date_format(d, "yyyy-MM"), "DATE": lambda d: F.date_format(d, "yyyy-MM-dd"), "WEEKDAY": lambda d: F.date_format(d, "EEEE"),
    "ISO_WEEK": lambda d: F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")),
}


def by_period(daily: DataFrame, key: str, *more: str) -> DataFrame:
    """``daily(day, category, mmsi, observed, loss)`` by a period, category and ``more`` columns such as ``bin``: sums, vessels, active days, rate."""
    df = daily.withColumn("period", PERIOD_KEYS[key](F.col("day"))).groupBy("period", "category", *more)
    df = df.agg(F.sum("observed").alias("observed"), F.sum("loss").alias("loss"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct("day").alias("days"))
    return df.withColumn("loss_pct", F.expr(rates.percent("loss", "observed + loss")))


def matched_period(daily: DataFrame, last: str) -> DataFrame:
    """Days up to month and day ``last`` (MM-DD) of each year, so that years of different length compare."""
    return daily.where(F.date_format("day", "MM-dd") <= last)


def weekday_means(daily_rates: DataFrame) -> DataFrame:
    """Mean observed and expected messages a day, by weekday (1 is Monday) and category."""
    day = (F.weekday("day") + 1).alias("weekday")
    return daily_rates.groupBy(day, "category").agg(F.count("*").alias("days"), F.avg("observed").alias("mean_observed"), F.avg(F.col("observed") + F.col("loss")).alias("mean_expected"))


def rolling(daily_rates: DataFrame, window: int, least: int, value: str = "loss_pct") -> DataFrame:
    """Mean of the last ``window`` rows of a category, given at least ``least`` of them; rows, not days."""
    w = Window.partitionBy("category").orderBy("day").rowsBetween(1 - window, 0)
    return daily_rates.withColumn(f"rolling_{window}", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def monthly_of_daily(daily_rates: DataFrame) -> DataFrame:
    q = F.percentile("loss_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    df = daily_rates.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "category").agg(F.avg("vessels").alias("mean_vessels"), q.alias("q"))
    return df.select("month", "category", "mean_vessels", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def trends(daily_rates: DataFrame) -> DataFrame:
    """OLS slope per 30 days, Spearman correlation of expected and rate, mean and sample deviation."""
    def ranked(c: str) -> Column:
        w = Window.partitionBy("category")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(w.partitionBy("category", c)) - 1) / 2.0

    df = daily_rates.where("loss_pct is not null").withColumns({"x": F.datediff("day", F.lit("2000-01-01")).cast("double"), "e": F.col("observed") + F.col("loss")})
    df = df.withColumn("re", ranked("e")).withColumn("rr", ranked("loss_pct"))
    return df.groupBy("category").agg((F.regr_slope("loss_pct", "x") * 30).alias("slope_30d"), F.corr("re", "rr").alias("spearman"), F.avg("loss_pct").alias("mean_pct"), F.stddev_samp("loss_pct").alias("sd_pct"))


def year_comparison(daily_bins: DataFrame, max_km: int = 80, least_vessels: int = 3) -> DataFrame:
    """Every year, category and bin up to ``max_km``: zero where nothing was, rate null where nothing was expected."""
    years = daily_bins.select(F.year("day").alias("year"), "category").distinct()
    spine = years.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max_km // BIN_KM - 1))))
    sums = daily_bins.groupBy(F.year("day").alias("year"), "category", "bin").agg(F.sum("observed").alias("observed"), F.sum("loss").alias("loss"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct("mmsi", "day").alias("vessel_days"))
    df = spine.join(sums, ["year", "category", "bin"], "left").fillna(0, ["observed", "loss", "vessels", "vessel_days"])
    return df.withColumns({"loss_pct": F.expr(rates.percent("loss", "observed + loss")), "loss_per_vessel_day": F.expr("CASE WHEN vessel_days > 0 THEN CAST(loss AS DOUBLE) / vessel_days END"), "small_sample": F.col("vessels") < least_vessels})


WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def on_weekday(daily: DataFrame, weekday: str = "ALL") -> DataFrame:
    return daily if weekday == "ALL" else daily.where(F.weekday("day") == WEEKDAYS.index(weekday))


def bin_metrics(daily_bins: DataFrame, weekday: str = "ALL", max_km: int = 80, width: int = BIN_KM, least_vessels: int = 3) -> DataFrame:
    """Every bin up to ``max_km`` on one weekday or all: sums, rate, and losses per vessel and day (vessels times days); rates are null below ``least_vessels``."""
    chosen = on_weekday(daily_bins, weekday)
    sums = chosen.groupBy("bin").agg(F.sum("observed").alias("observed"), F.sum("loss").alias("loss"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct("day").alias("days"))
    spine = daily_bins.sparkSession.range((max_km - width // 2 + width - 1) // width).select(F.col("id").cast("int").alias("bin"))
    df = spine.join(sums, "bin", "left").fillna(0, ["observed", "loss", "vessels", "days"]).withColumn("small_sample", F.col("vessels") < least_vessels)
    sure = lambda c: F.when(~F.col("small_sample"), c)
    return df.withColumns({"loss_pct": sure(F.expr(rates.percent("loss", "observed + loss"))), "loss_per_vessel_day": sure(F.expr("CASE WHEN vessels > 0 THEN CAST(loss AS DOUBLE) / (vessels * days) END"))})


def overall_metrics(daily_bins: DataFrame, weekday: str = "ALL", keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals over all bins, whose vessels and days count once; zeros where nothing is."""
    df = on_weekday(daily_bins, weekday).groupBy(*keys).agg(F.countDistinct("day").alias("days"), F.countDistinct("mmsi").alias("vessels"), F.coalesce(F.sum("observed"), F.lit(0)).alias("observed"), F.coalesce(F.sum("loss"), F.lit(0)).alias("loss"))
    return df.withColumns({"loss_pct": F.expr(f"coalesce({rates.percent('loss', 'observed + loss')}, 0e0)"), "loss_per_vessel_day": F.expr("CASE WHEN vessels > 0 THEN CAST(loss AS DOUBLE) / (vessels * days) ELSE 0e0 END")})


def density(reports: DataFrame, max_km: float = 80.0, size: int = 40) -> DataFrame:
    """Counts on a square latitude-longitude grid around the receiver; the outer edges are closed."""
    half_lat = max_km / 111.32
    import math

    half_lon = max_km / (111.32 * math.cos(math.radians(geo.RECEIVER_LAT)))
    def at(c: str, middle: float, half: float) -> Column:
        k = F.floor((F.col(c) - (middle - half)) / (2 * half / size)).cast("int")
        return F.when(F.col(c) == middle + half, size - 1).when((F.col(c) >= middle - half) & (F.col(c) < middle + half), k)

    df = reports.withColumn("gy", at("lat", geo.RECEIVER_LAT, half_lat)).withColumn("gx", at("lon", geo.RECEIVER_LON, half_lon))
    return df.where("gx is not null and gy is not null").groupBy("gx", "gy").agg(F.count("*").alias("n"))
