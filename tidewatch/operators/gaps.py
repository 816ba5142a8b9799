"""Diagnostics of the gaps between a vessel's messages, by category and by class-B unit and speed.

Gaps are counted by whole second before anything is ranked: a group then has 1800 counters at most, which combine before they shuffle, and
percentiles are read off their running sum. So no group's gaps meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import rates
from tidewatch.operators.legacy import category

NS, MOST_SECONDS = rates.NS, 1800
CLASSES = {"0-2": 2.0, "2-14": 14.0}


def message_gaps(reports: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Each message after the first of its vessel and category, in order of arrival: ``gap_s``, the start's ``own_s``, speed and unit, and what it counts as."""
    w = Window.partitionBy("mmsi", "category").orderBy(*order)
    df = reports.withColumn("category", category(F.col("message_type"))).where("category IS NOT NULL")
    df = df.withColumn("own_s", F.when(F.col("category") == 5, 360.0).otherwise(F.col("expected_here")))
    df = df.withColumn("start", F.lag(F.struct("ts_ns", "own_s", "sog", "class_b_mode")).over(w)).withColumn("gap_s", F.floor((F.col("ts_ns") - F.col("start.ts_ns")) / 1_000_000) / 1000.0)
    far = F.col("gap_s") >= F.expr(rates.legacy_gap_seconds("category"))
    kind = F.when(F.col("start").isNull(), "FIRST").when(F.col("gap_s") < 0, "NEGATIVE").when(far, "TRACK_GAP").when(~F.coalesce(F.col("start.own_s") > 0, F.lit(False)), "NO_EXPECTED").otherwise("VALID")
    ok = F.col("kind") == "VALID"
    whole = F.floor(F.col("gap_s") + 0.5)
    df = df.withColumn("kind", kind).withColumn("own_s", F.col("start.own_s"))
    return df.withColumns({
        "loss": F.when(ok, F.expr(rates.losses("gap_s", "own_s"))), "integer_loss": F.when(ok, F.expr(rates.losses("floor(gap_s + 0.5e0)", "own_s"))),
        "ceil_loss": F.when(ok & (F.col("category") == 5), F.greatest(F.lit(0), F.ceil(whole / F.col("own_s") - 1))), "whole_s": whole,
    })


def gap_totals(gaps: DataFrame) -> DataFrame:
    """Per category: messages, gaps by kind, and losses counted with exact, whole-second and rounded-up times."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    some = F.col("kind") != "FIRST"
    return gaps.groupBy("category").agg(
        F.count("*").alias("messages"), F.count_if(some).alias("intervals"), kind("NEGATIVE").alias("negative"), F.count_if(F.col("gap_s") == 0).alias("zero"), F.count_if((F.col("gap_s") >= 0) & (F.col("gap_s") < 0.5)).alias("below_half"),
        kind("TRACK_GAP").alias("track_gaps"), kind("NO_EXPECTED").alias("no_expected"), kind("VALID").alias("valid"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("loss", "integer_loss", "ceil_loss")],
        F.count_if(F.col("loss") != F.col("integer_loss")).alias("changed"))


def expected_histogram(gaps: DataFrame) -> DataFrame:
    """How often each expected interval was in force."""
    return gaps.where("kind = 'VALID'").groupBy("category", F.round("own_s", 6).alias("expected_s")).agg(F.count("*").alias("n"))


def ranked_seconds(counts: DataFrame, keys: list[str], fractions: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """Smallest second at which the running count reaches a share of all, for ``counts(keys, whole_s, n)``; columns p50 and so on."""
    up = F.sum("n").over(Window.partitionBy(*keys).orderBy("whole_s").rowsBetween(Window.unboundedPreceding, 0))
    df = counts.withColumn("up", up).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col("up") >= F.ceil(F.col("total") * f), F.col("whole_s"))).cast("bigint").alias(f"p{round(f * 100)}") for f in fractions])


def speed_class(sog: Column) -> Column:
    out = F.lit(">14")
    for name, most in reversed(CLASSES.items()):
        out = F.when(sog <= most, name).otherwise(out)
    return F.coalesce(F.when(sog.isNotNull(), out), F.lit("0-2"))


def class_b_groups(gaps: DataFrame) -> DataFrame:
    """Class-B gaps by unit and speed at their start: number, losses and percentiles of whole seconds below half an hour."""
    unit = F.when(F.col("start.class_b_mode") == "CARRIER_SENSE", "CS").otherwise("SO")
    df = gaps.where("kind = 'VALID' AND category = 18").select(unit.alias("unit"), speed_class(F.col("start.sog")).alias("speed"), "whole_s", "loss")
    counts = df.groupBy("unit", "speed", "whole_s").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    ranks = ranked_seconds(counts.where(F.col("whole_s") < MOST_SECONDS), ["unit", "speed"])
    return counts.groupBy("unit", "speed").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).join(ranks, ["unit", "speed"], "left")
