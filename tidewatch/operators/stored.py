"""Questions to stored runs: which count, what they cover, and their facts rolled up without computing them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import cube


def included(runs: DataFrame, first: str, last: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Runs whose day lies in [first, last] and isn't excluded."""
    days = runs.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.where(~F.col("day").isin([F.lit(d).cast("date") for d in excluded])) if excluded else days


def day_states(runs: DataFrame, first: str, last: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Every day of the range: its number of active runs, and whether it is EXCLUDED, MISSING, INCLUDED or AMBIGUOUS (several runs)."""
    days = runs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counted = days.join(runs.groupBy("day").agg(F.count("*").alias("runs")), "day", "left").fillna(0, ["runs"])
    out = F.col("day").isin([F.lit(d).cast("date") for d in excluded]) if excluded else F.lit(False)
    return counted.withColumn("state", F.when(out, "EXCLUDED").when(F.col("runs") == 0, "MISSING").when(F.col("runs") > 1, "AMBIGUOUS").otherwise("INCLUDED"))


def overlapping(runs: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """Runs that reach into [from, to); one without an end ends when it starts."""
    return runs.where((F.coalesce("ended_us", "started_us") >= from_us) & (F.col("started_us") < to_us))


def _period(at: Column, dimension: str) -> Column:
    return F.lpad(cube.jst_hour(at).cast("string"), 2, "0") if dimension == "HOUR_OF_DAY" else cube.period(cube.jst_day(at), dimension)


def rollup(facts: DataFrame, presence: DataFrame, runs: DataFrame, dimension: str, place: tuple[str, ...] = ("band",), vessel_class: str | None = None) -> DataFrame:
    """Stored facts of ``runs`` by period, place and class: measures, first and last bucket, days, and vessels from presence.

    ``presence`` has a row per run, hour, place, class and vessel, so vessels are exact at any grain. Facts without presence have 0 vessels.
    """
    keys = ["period", *place, "vessel_class"]
    ids = runs.select("run_id")

    def chosen(df: DataFrame, at: str) -> DataFrame:
        df = df if vessel_class is None else df.where(F.col("vessel_class") == vessel_class)
        return df.join(ids, "run_id", "left_semi").withColumn("period", _period(F.col(at), dimension))

    sums = chosen(facts, "bucket").groupBy(*keys).agg(*[F.sum(m).alias(m) for m in cube.MEASURES], F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.countDistinct(cube.jst_day(F.col("bucket"))).alias("days"))
    vessels = chosen(presence, "hour_ns").groupBy(*keys).agg(F.countDistinct("mmsi").alias("vessels"))
    return cube.evaluated(sums.join(vessels, keys, "left").fillna(0, ["vessels"]))


def run_days(runs: DataFrame, first: str, last: str, excluded: tuple[str, ...] = (), receiver: str | None = None, profile: str | None = None) -> DataFrame:
    """(day, run_id) of the days of a range that count: not excluded, with one active run of the receiver and profile.

    What the other days lack, ``day_states`` says; two active runs on a day are its AMBIGUOUS, and neither counts.
    """
    for column, wanted in (("receiver", receiver), ("profile", profile)):
        runs = runs if wanted is None else runs.where(F.col(column) == wanted)
    return included(runs, first, last, excluded).groupBy("day").agg(F.min("run_id").alias("run_id"), F.count("*").alias("n_")).where("n_ = 1").drop("n_")


def demand_one_run(runs: DataFrame, first: str, last: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``run_days`` that fail when read if a day has several active runs."""
    days = included(runs, first, last, excluded).groupBy("day").agg(F.min("run_id").alias("run_id"), F.count("*").alias("n_"))
    wrong = F.raise_error(F.concat(F.lit("several active runs on "), F.col("day").cast("string")))
    return days.withColumn("run_id", F.when(F.col("n_") > 1, wrong.cast("string")).otherwise(F.col("run_id"))).drop("n_")


def _of_days(table: DataFrame, days: DataFrame) -> DataFrame:
    return table.join(days, "run_id")


def calibration_rows(facts: DataFrame, presence: DataFrame, days: DataFrame) -> DataFrame:
    """Per day, band and class: counts, and the vessels present, those of a known class only. Facts lead: presence without them is left out."""
    keys = ["day", "band", "vessel_class"]
    sums = _of_days(facts, days).where("vessel_class IN ('A', 'B')").groupBy(*keys).agg(F.sum("observed").alias("observed"), F.sum("missing").alias("missing"))
    # a day's vessels in a band and class are one receiver's: some thousands
    there = _of_days(presence, days).groupBy(*keys).agg(F.array_sort(F.collect_set("mmsi")).alias("vessels"))
    return sums.join(there, keys, "left").withColumn("vessels", F.coalesce("vessels", F.array().cast("array<int>")))


def observed_validation(facts: DataFrame, presence: DataFrame, days: DataFrame) -> DataFrame:
    """Per band and class: pooled measures, days, distinct vessels, and the daily loss and stale percentages in order of days.

    A day whose denominator is zero gives no rate; vessels are 0 without presence.
    """
    keys = ["band", "vessel_class"]
    daily = _of_days(facts, days).groupBy("day", *keys).agg(*[F.sum(m).alias(m) for m in cube.MEASURES])
    rate = lambda part, whole: F.when(whole > 0, part * 100.0 / whole)
    rated = daily.withColumns({"loss_pct": rate(F.col("missing"), F.col("observed") + F.col("missing")), "stale_pct": rate(F.col("stale_s"), F.col("observed_s"))})
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("day", c)))), lambda x: x[c])
    lists = [in_order(c).alias(f"daily_{c}") for c in ("loss_pct", "stale_pct")]
    pooled = rated.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in cube.MEASURES], F.count("*").alias("days"), *lists)
    vessels = _of_days(presence, days).groupBy(*keys).agg(F.countDistinct("mmsi").alias("vessels"))
    return pooled.join(vessels, keys, "left").fillna(0, ["vessels"])


_WEEK = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def answered(rolled: DataFrame, runs: DataFrame) -> DataFrame:
    """A ``rollup`` as it is shown: weekdays from Monday on, other periods by name, then band and class; with a label of the band and the number of runs behind it."""
    week = F.array_position(F.array(*[F.lit(d) for d in _WEEK]), F.col("period"))
    there = [c for c in ("band",) if c in rolled.columns]
    label = [F.concat((F.col("band") * 5).cast("string"), F.lit("-"), ((F.col("band") + 1) * 5).cast("string"), F.lit(" km")).alias("band_label")] if there else []
    df = rolled.join(F.broadcast(runs.agg(F.count("*").alias("included_runs"))))  # one row
    return df.select("*", *label).orderBy(week, "period", *there, "vessel_class")


def current(facts: DataFrame) -> DataFrame:
    """A session's five-minute rows summed by class and band."""
    return facts.groupBy("vessel_class", "band").agg(*[F.sum(m).alias(m) for m in cube.MEASURES])


def next_revision(models: DataFrame, receiver: str) -> DataFrame:
    """One row: the revision that a new model of the receiver takes."""
    return models.where(F.col("receiver") == receiver).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def profile_on(profiles: DataFrame, day: str) -> DataFrame:
    """Of each receiver the profile valid on a day: valid_from <= day, and valid_to open or not before it; the latest start wins."""
    at = F.lit(day).cast("date")
    valid = profiles.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    newest = F.row_number().over(Window.partitionBy("receiver").orderBy(F.desc("valid_from"), "profile"))
    return valid.withColumn("n_", newest).where("n_ = 1").drop("n_")


def profile_overlaps(profiles: DataFrame) -> DataFrame:
    """Profiles that start before an earlier one of their receiver has ended."""
    w = Window.partitionBy("receiver").orderBy("valid_from", "profile").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    return profiles.withColumn("until_", F.max(end).over(w)).where(F.col("valid_from") <= F.col("until_")).drop("until_")


def upserted(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with ``changes`` in place of rows of the same (receiver, profile)."""
    return profiles.join(changes.select("receiver", "profile").distinct(), ["receiver", "profile"], "left_anti").select(*profiles.columns).unionByName(changes.select(*profiles.columns))


def trainable(runs: DataFrame, model: DataFrame, profiles: DataFrame, receiver: str, first: str, last: str) -> DataFrame:
    """One row: what keeps a model from being saved, empty if nothing. Its receiver must be valid at both ends."""
    ends = [F.count_if((F.col("receiver") == receiver) & (F.col("valid_from") <= F.lit(d).cast("date")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(d).cast("date")))).alias(n) for d, n in ((first, "at_first"), (last, "at_last"))]
    facts = profiles.agg(*ends).crossJoin(runs.agg(F.count("*").alias("n_runs"))).crossJoin(model.agg(F.count_if(F.col("kind") == "DIRECT").alias("n_direct")))  # one row each
    wrong = F.array(F.when(F.col("at_first") == 0, "RECEIVER_NOT_VALID_AT_START"), F.when(F.col("at_last") == 0, "RECEIVER_NOT_VALID_AT_END"), F.when(F.col("n_runs") == 0, "NO_SOURCE_RUN"), F.when(F.col("n_direct") == 0, "NO_DIRECT_CELL"))
    return facts.select(F.array_compact(wrong).alias("problems"))
