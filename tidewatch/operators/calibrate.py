"""Calibration of the distance-and-class reception model, deterministic simulation and its validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import cube, intervals
from tidewatch.sources.work import saved

CLASSES = ("A", "B")
LEAST_EXPECTED, LEAST_VESSELS, LEAST_DAYS, WIDEST_CI = 30, 3, 5, 0.20
_M64 = (1 << 64) - 1

#: Rows that a task of the validation should get. All its windows hold a task's rows, and sizes in bytes say little: of a simulated row some 20 bytes are shuffled, and a few hundred are held.
TASK_ROWS = 100_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def jeffreys(observed: str, expected: str) -> str:
    return f"(({observed}) + 0.5e0) / (({expected}) + 1e0)"


def pooled(days: DataFrame) -> DataFrame:
    """Per band and class: raw and Jeffreys reception and the days with anything expected; ``days(day, band, vessel_class, observed, missing, mmsi)``."""
    df = days.groupBy("band", "vessel_class").agg(F.sum("observed").alias("observed"), F.sum("missing").alias("missing"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct(F.when(F.col("observed") + F.col("missing") > 0, F.col("day"))).alias("days"))
    df = df.withColumn("expected", F.col("observed") + F.col("missing"))
    some = F.col("expected") > 0
    return df.withColumns({"raw_loss": F.when(some, F.col("missing") / F.col("expected")), "raw_reception": F.when(some, F.col("observed") / F.col("expected")), "p": F.when(some, F.expr(jeffreys("observed", "expected")))})


def splittable_below(seed: int, bound: int, count: int) -> np.ndarray:
    """``count`` integers in [0, bound), as java.util.SplittableRandom (the published SplitMix64) draws them.

    Its state is a counter, so all draws are made at once. A draw that would favour small numbers is skipped, which only moves on the counter.
    """
    def draws(first: int, n: int) -> np.ndarray:
        z = np.uint64(seed & _M64) + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0x62A9D9ED799705F5)
        return ((z ^ (z >> np.uint64(28))) * np.uint64(0xCB24D0A5C88C35B3)) >> np.uint64(32)

    if bound & (bound - 1) == 0:
        return (draws(0, count) & np.uint64(bound - 1)).astype(np.int64)
    found, at = np.empty(0, np.int64), 0
    while len(found) < count:
        n = count - len(found) + 16
        u = (draws(at, n) >> np.uint64(1)).astype(np.int64)
        found, at = np.concatenate((found, (u % bound)[u + bound - 1 - u % bound < 1 << 31])), at + n
    return found[:count]


def cell_seed(seed: int, band: int, vessel_class: str) -> int:
    """Seed of one cell, wrapped to 64 bits; the factors are fixed values."""
    return (seed ^ 0x9E3779B97F4A7C15 ^ band * 0xBF58476D1CE4E5B9 ^ CLASSES.index(vessel_class) * 0x94D049BB133111EB) & _M64


def day_bootstrap(rows: list[tuple[int, int]], iterations: int, seed: int) -> tuple[float, float]:
    """2.5 and 97.5 percent bounds of the Jeffreys rate over resampled days (observed, expected)."""
    n = len(rows)
    picks = splittable_below(seed, n, iterations * n).reshape(iterations, n)
    table = np.array(rows, np.float64)[picks].sum(axis=1)
    rates = np.sort((table[:, 0] + 0.5) / (table[:, 1] + 1))
    return float(rates[int(np.floor(0.025 * (iterations - 1)))]), float(rates[int(np.ceil(0.975 * (iterations - 1)))])


def intervals_by_bootstrap(days: DataFrame, iterations: int = 1000, seed: int = 20251006) -> DataFrame:
    """Confidence bounds per band and class; at most bands x classes groups of one row per day."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        lo, hi = day_bootstrap(list(zip(rows.observed, rows.observed + rows.missing, strict=True)), iterations, cell_seed(seed, int(key[0]), key[1]))
        return pd.DataFrame({"band": [key[0]], "vessel_class": [key[1]], "ci_low": [lo], "ci_high": [hi]})

    daily = days.groupBy("day", "band", "vessel_class").agg(F.sum("observed").alias("observed"), F.sum("missing").alias("missing"))
    return daily.groupBy("band", "vessel_class").applyInPandas(one, "band int, vessel_class string, ci_low double, ci_high double")


def parameters(estimates: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The whole grid of bands and classes: DIRECT, INTERPOLATED or OUT_OF_MODEL with its probability."""
    spark = estimates.sparkSession
    grid = spark.range(geo.BANDS).select(F.col("id").cast("int").alias("band"), F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("vessel_class"))
    df = grid.join(estimates, ["band", "vessel_class"], "left")
    ok = (F.col("expected") >= LEAST_EXPECTED) & (F.col("vessels") >= LEAST_VESSELS) & (F.col("days") >= LEAST_DAYS)
    if bounds is not None:
        df = df.join(bounds, ["band", "vessel_class"], "left")
        ok = ok & (F.col("ci_high") - F.col("ci_low") <= WIDEST_CI)
    df = df.withColumn("direct", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy("vessel_class").orderBy("band")
    source = F.when(F.col("direct"), F.struct("band", "p"))
    below, above = F.last(source, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(source, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumn("below", below).withColumn("above", above)
    between = ~F.col("direct") & F.col("below").isNotNull() & F.col("above").isNotNull()
    line = F.col("below.p") + (F.col("above.p") - F.col("below.p")) * (F.col("band") - F.col("below.band")) / (F.col("above.band") - F.col("below.band"))
    return df.select(
        "band", "vessel_class", F.when(F.col("direct"), "DIRECT").when(between, "INTERPOLATED").otherwise("OUT_OF_MODEL").alias("kind"), F.when(F.col("direct"), F.col("p")).when(between, line).alias("p"),
        F.when(between, F.col("below.band")).alias("from_band"), F.when(between, F.col("above.band")).alias("to_band"),
    )


def ideal_transmissions(intervals: DataFrame, lost: DataFrame) -> DataFrame:
    """Every report as an anchor and every missed one as interpolated, with an order that doesn't depend on input order.

    ``lost`` are missing positions with the attributes of their start report.
    """
    anchors = intervals.select("mmsi", "vessel_class", F.col("ts_ns").alias("planned_ns"), "lat", "lon", F.lit(0).alias("origin"), "seq")
    made = lost.select("mmsi", "vessel_class", F.col("at_ns").alias("planned_ns"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.lit(1).alias("origin"), "seq")
    w = Window.partitionBy("mmsi", "vessel_class", "planned_ns").orderBy("origin", "seq")
    return anchors.union(made).withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint")).drop("seq")


def _be(value: Column, digits: int) -> Column:
    return F.right(F.concat(F.lit("0" * digits), F.hex(value.cast("bigint"))), F.lit(digits))


def uniform(seed: Column | int, model_msb: int, model_lsb: int, day: Column, mmsi: Column, vessel_class: Column, at_ns: Column, ordinal: Column) -> Column:
    """Deterministic uniform of a transmission: top 53 bits of SHA-256 over its big-endian identity."""
    ns = F.lit(1_000_000_000)
    code = F.when(vessel_class == "B", 1).otherwise(0)
    seconds, nanos = F.floor(at_ns / ns), F.pmod(at_ns, ns)
    seed = F.lit(seed) if isinstance(seed, int) else seed
    whole = F.concat(_be(seed, 16), _be(F.lit(model_msb), 16), _be(F.lit(model_lsb), 16), _be(day, 16), _be(mmsi, 8), _be(code, 8), _be(seconds, 16), _be(nanos, 8), _be(ordinal, 16))
    digest = F.sha2(F.unhex(whole), 256)
    return F.shiftright(F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint"), 3) * F.lit(2.0**-53)


def decided(transmissions: DataFrame, model: DataFrame, u: Column) -> DataFrame:
    """RECEIVED, LOST or OUT_OF_MODEL by distance band and class. The model has one row per cell of a fixed grid."""
    df = transmissions.withColumn("km", F.expr(geo.receiver_km("lat", "lon"))).withColumn("band", F.when(F.col("km") < geo.BAND_KM * geo.BANDS, F.floor(F.col("km") / geo.BAND_KM).cast("int")))
    df = df.withColumn("u", u).join(F.broadcast(model.select("band", "vessel_class", "p")), ["band", "vessel_class"], "left")
    return df.withColumn("decision", F.when(F.col("p").isNull(), "OUT_OF_MODEL").when(F.col("u") < F.col("p"), "RECEIVED").otherwise("LOST"))


def class_baseline(days: DataFrame) -> DataFrame:
    """One Jeffreys rate per class over all cells."""
    df = days.groupBy("vessel_class").agg(F.sum("observed").alias("observed"), F.sum(F.col("observed") + F.col("missing")).alias("expected"))
    return df.select("vessel_class", F.expr(jeffreys("observed", "expected")).alias("p"))


def received_with_boundaries(decisions: DataFrame) -> DataFrame:
    """Received rows; ``boundary`` marks the first one after any out-of-model row of the same vessel and class."""
    w = Window.partitionBy("mmsi", "vessel_class").orderBy("planned_ns", "ordinal")
    out = F.sum(F.when(F.col("decision") == "OUT_OF_MODEL", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = decisions.withColumn("outs", out).where("decision = 'RECEIVED'")
    before = F.lag("outs").over(w)
    return kept.withColumn("boundary", F.coalesce(F.col("outs") > before, F.lit(False))).drop("outs")


def replayed(reports: DataFrame) -> DataFrame:
    """Each JST day's ideal transmissions, anchors and interpolated ones with the attributes of their start report; days apart."""
    attributes = [c for c in ("class_b_mode", "message_type", "sog", "cog", "heading", "nav_status") if c in reports.columns]
    of_day = reports.withColumn("day", cube.jst_day(F.col("ts_ns"))).withColumn("mmsi", F.struct("day", "mmsi")).repartition(tasks_for(reports.count()), "mmsi")
    w = Window.partitionBy("mmsi", "vessel_class").orderBy("ts_ns", "seq")
    whole = intervals.analyzed(of_day, dealt=True).withColumn("own", F.struct(*attributes)).withColumn("of_start", F.lag("own").over(w))
    made = cube.missing_positions(cube.projected(whole.where("reason is null")))
    shown = lambda df, at, lat, lon, origin, own: df.select("mmsi", "vessel_class", F.col(at).alias("planned_ns"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.lit(origin).alias("origin"), "seq", F.col(own).alias("own"))
    both = saved(shown(whole, "ts_ns", "lat", "lon", 0, "own").union(shown(made, "at_ns", "p_lat", "p_lon", 1, "of_start")), "transmissions")
    key = ["mmsi", "vessel_class", "planned_ns"]
    order = Window.partitionBy(*key).orderBy("origin", "seq")
    dealt = both.repartition(tasks_for(both.count()), *key)
    return dealt.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint")).select("mmsi.day", "mmsi.mmsi", "vessel_class", "planned_ns", "lat", "lon", "origin", "ordinal", "own.*")


def simulated_counts(transmissions: DataFrame, model: DataFrame, baseline: DataFrame, seeds: int, base_seed: int = 1) -> DataFrame:
    """Observed and missing per (seed, variant, band, class), from the received rows sent through the interval engine again.

    Seeds and variants fan out by a generator; each of them and each day is a vessel of its own to the engine. They are dealt once, over as many tasks as their number asks for.
    """
    fan = transmissions.withColumn("seed", F.explode(F.sequence(F.lit(base_seed).cast("bigint"), F.lit(base_seed + seeds - 1).cast("bigint"))))
    day = F.datediff("day", F.lit("1970-01-01"))
    both = decided(fan, model, uniform(F.col("seed"), 1, 2, day, F.col("mmsi"), F.col("vessel_class"), F.col("planned_ns"), F.col("ordinal")))
    both = both.join(F.broadcast(baseline.withColumnRenamed("p", "q")), "vessel_class", "left")
    # the baseline, too, is out of model outside the bands
    plain = F.when(F.col("band").isNull() | F.col("q").isNull(), "OUT_OF_MODEL").when(F.col("u") < F.col("q"), "RECEIVED").otherwise("LOST")
    both = both.withColumn("v", F.explode(F.array(F.struct(F.lit("CM_E1").alias("variant"), F.col("decision").alias("made")), F.struct(F.lit("CLASS_ONLY").alias("variant"), plain.alias("made")))))
    runs = both.withColumns({"decision": F.col("v.made"), "mmsi": F.struct("seed", F.col("v.variant").alias("variant"), "day", "mmsi")}).drop("band", "km", "p", "q", "u", "v", "seed", "day")
    runs = runs.repartition(tasks_for(transmissions.count() * seeds * 2), "mmsi")
    got = received_with_boundaries(runs).withColumn("ts_ns", F.col("planned_ns")).withColumn("seq", F.col("ordinal") * 2 + F.when(F.col("vessel_class") == "B", 1).otherwise(0))
    counts = cube.band_counts(cube.projected(intervals.analyzed(got, dealt=True).where("reason is null")))
    return counts.groupBy(F.col("mmsi.seed").alias("seed"), F.col("mmsi.variant").alias("variant"), "band", "vessel_class").agg(F.sum(F.col("observed") + F.col("missing")).alias("expected"), F.sum("missing").alias("lost"))


def summarized(runs: DataFrame) -> DataFrame:
    """Mean, median, extremes and 95 percent range of the simulated loss percentages."""
    pct = F.when(F.col("expected") > 0, F.col("lost") * 100.0 / F.col("expected"))
    q = F.percentile("pct", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    df = runs.withColumn("pct", pct).groupBy("variant", "band", "vessel_class").agg(F.avg("pct").alias("mean"), q.alias("q"), F.min("pct").alias("least"), F.max("pct").alias("most"))
    return df.select("variant", "band", "vessel_class", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "least", "most")


def compared(observed: DataFrame, summary: DataFrame) -> DataFrame:
    """Status of each cell and what enters the weighted errors; ``observed(band, vessel_class, loss_pct, expected, day_low, day_high)``."""
    df = observed.join(summary, ["band", "vessel_class"], "left")
    hit = F.col("loss_pct").between(F.col("low"), F.col("high")) | F.col("mean").between(F.col("day_low"), F.col("day_high"))
    status = F.when(F.col("mean").isNull() | F.col("loss_pct").isNull(), "OUT_OF_MODEL").when(hit, "MATCH").otherwise("REVIEW")
    return df.withColumn("status", status).withColumn("error", F.abs(F.col("mean") - F.col("loss_pct")))


def weighted_error(cells: DataFrame) -> DataFrame:
    """MAE by variant, weighted by expected transmissions, with comparable and matching cells."""
    some = cells.where("status <> 'OUT_OF_MODEL'")
    return some.groupBy("variant").agg((F.sum(F.col("expected") * F.col("error")) / F.sum("expected")).alias("mae"), F.count("*").alias("comparable"), F.count_if(F.col("status") == "MATCH").alias("matching"))
