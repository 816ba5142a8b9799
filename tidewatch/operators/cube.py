"""Five-minute fact tables: observed and missing counts, observed and stale seconds by place, time and class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates
from tidewatch.functions.steps import held, with_steps

NS, BUCKET_NS, DAY_NS, JST_NS = rates.NS, 300 * rates.NS, 86_400 * rates.NS, 9 * 3600 * rates.NS
MEASURES = ["observed", "missing", "observed_s", "stale_s"]
_QUADRATIC = ["qa", "qb", "qc"]


def bucket(ns: Column) -> Column:
    """Start of the five-minute bucket; the zone's offset is a multiple of five minutes."""
    return ns - F.pmod(ns, F.lit(BUCKET_NS))


def jst_day(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ns + JST_NS) / DAY_NS).cast("int"))


def jst_hour(ns: Column) -> Column:
    return F.floor(F.pmod(ns + JST_NS, F.lit(DAY_NS)) / (3600 * NS)).cast("int")


def split_buckets(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row per bucket that [a, b) touches, with its share as seconds ``part_s``; empty intervals give none."""
    last = bucket(F.col(b) - 1)
    df = df.where(F.col(a) < F.col(b)).withColumn("bucket", F.explode(F.sequence(bucket(F.col(a)), last, F.lit(BUCKET_NS))))
    lo, hi = F.greatest(F.col(a), F.col("bucket")), F.least(F.col(b), F.col("bucket") + BUCKET_NS)
    return df.withColumn("part_ns", lo).withColumn("part_end_ns", hi).withColumn("part_s", (hi - lo) / float(NS))


def projected(intervals: DataFrame) -> DataFrame:
    df = with_steps(intervals, geo.to_utm("start_lat", "start_lon", "e0", "n0") + geo.to_utm("lat", "lon", "e1", "n1"))
    return df.drop(*geo.utm_scratch("e0"), *geo.utm_scratch("e1"))


def missing_positions(intervals: DataFrame) -> DataFrame:
    """Estimated place and time of every missed transmission: evenly spaced, straight in the projected plane."""
    df = intervals.where("missing > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("missing"))))
    step = F.floor(F.col("i") * F.col("expected_s") * NS + 0.5).cast("bigint")
    ratio = step / F.col("delta_ns")
    df = df.withColumn("at_ns", F.col("start_ns") + step).withColumn("pe", F.col("e0") + (F.col("e1") - F.col("e0")) * ratio).withColumn("pn", F.col("n0") + (F.col("n1") - F.col("n0")) * ratio)
    return with_steps(df, geo.from_utm("pe", "pn", "p_lat", "p_lon"), geo.geo_scratch("p_lat"))


def _cuts_on_axis(a: str, b: str) -> Column:
    """Ratios at which a segment crosses grid lines of one axis."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    first, last = F.floor(lo / geo.GRID_M) + 1, F.ceil(hi / geo.GRID_M) - 1
    lines = F.when((F.abs(F.col(b) - F.col(a)) >= 1e-9) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * geo.GRID_M - F.col(a)) / (F.col(b) - F.col(a)))


def _ordered(cuts: Column) -> Column:
    """Distinct ratios from 0 to 1, both ends included."""
    inside = F.filter(cuts, lambda r: (r > 1e-12) & (r < 1 - 1e-12))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inside)))


def _pieces(df: DataFrame, cuts: Column) -> DataFrame:
    """Explode sorted cut ratios to pieces with times piece_ns..piece_end_ns and the midpoint me, mn."""
    df = df.withColumn("cuts", _ordered(cuts))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)))
    df = df.withColumn("r0", F.element_at("cuts", F.col("k"))).withColumn("r1", F.element_at("cuts", F.col("k") + 1)).drop("cuts", "k")
    mid = (F.col("r0") + F.col("r1")) / 2
    at = lambda r: F.col("start_ns") + F.floor(F.col("delta_ns") * F.col(r) + 0.5).cast("bigint")
    df = df.withColumns({"piece_ns": at("r0"), "piece_end_ns": at("r1"), "me": F.col("e0") + (F.col("e1") - F.col("e0")) * mid, "mn": F.col("n0") + (F.col("n1") - F.col("n0")) * mid})
    return df.where("piece_ns < piece_end_ns")


def _grid_cuts() -> Column:
    return F.concat(_cuts_on_axis("e0", "e1"), _cuts_on_axis("n0", "n1"))


def grid_pieces(intervals: DataFrame) -> DataFrame:
    """Parts of each interval by grid cell (col, row)."""
    df = _pieces(intervals, _grid_cuts())
    return df.withColumn("col", F.expr(geo.cell("me"))).withColumn("row", F.expr(geo.cell("mn")))


def receiver_utm() -> tuple[float, float]:
    """Receiver in the plane, with the same series evaluated on the driver."""
    lat, lon = math.radians(geo.RECEIVER_LAT), math.radians(geo.RECEIVER_LON - geo._LON0)
    t = math.sinh(math.atanh(math.sin(lat)) - geo._ROOT * math.atanh(geo._ROOT * math.sin(lat)))
    x, y = math.atan2(t, math.cos(lon)), math.atanh(math.sin(lon) / math.sqrt(1 + t * t))
    e = y + sum(a * math.cos(2 * k * x) * math.sinh(2 * k * y) for k, a in enumerate(geo._ALPHA, 1))
    n = x + sum(a * math.sin(2 * k * x) * math.cosh(2 * k * y) for k, a in enumerate(geo._ALPHA, 1))
    return geo._FE + geo._K0 * geo._RADIUS * e, geo._K0 * geo._RADIUS * n


def within_bands(df: DataFrame, km: str) -> DataFrame:
    """Add ``band`` and keep the rows that lie in one.

    The band comes out of a generator: a filter on it would be pushed below all steps that lead to it and repeat them.
    """
    return df.withColumn("km_", F.expr(km)).withColumn("band", F.explode(F.array_compact(F.array(F.expr(geo.band("km_")))))).drop("km_")


def _with_circles(intervals: DataFrame, center: tuple[float, float] | None = None) -> tuple[DataFrame, Column]:
    """(rows with the coefficients ``_QUADRATIC``, ratios at which they cross the bands' circles)."""
    ce, cn = center or receiver_utm()
    de, dn, fe, fn = F.col("e1") - F.col("e0"), F.col("n1") - F.col("n0"), F.col("e0") - ce, F.col("n0") - cn
    df = intervals.withColumns({"qa": de * de + dn * dn, "qb": 2 * (fe * de + fn * dn), "qc": fe * fe + fn * fn})
    radii = F.array(*[F.lit(geo.BAND_KM * 1000 * k) for k in range(1, geo.BANDS + 1)])
    disc = lambda r: F.col("qb") * F.col("qb") - 4 * F.col("qa") * (F.col("qc") - r * r)
    root = lambda sign: F.transform(F.filter(radii, lambda r: (F.col("qa") > 1e-18) & (disc(r) >= 0)), lambda r: (-F.col("qb") + sign * F.sqrt(disc(r))) / (2 * F.col("qa")))
    return df, F.concat(root(-1), root(1))


def ring_pieces(intervals: DataFrame, center: tuple[float, float] | None = None) -> DataFrame:
    """Parts of each interval by distance band; cut by circles in the plane, named by the midpoint's spherical distance."""
    df, cuts = _with_circles(intervals, center)
    df = _pieces(df, cuts).drop(*_QUADRATIC)
    df = with_steps(df, geo.from_utm("me", "mn", "m_lat", "m_lon"), geo.geo_scratch("m_lat"))
    return within_bands(df, geo.receiver_km("m_lat", "m_lon"))


#: What an interval gives: its start, each missed point, each piece between cuts.
_START, _MISSED, _PIECE = 0, 1, 2
_ATOM = "struct<kind:int,r0:double,r1:double,a:bigint,b:bigint>"


def _atoms(flat: DataFrame, cuts: Column) -> DataFrame:
    """Start, missed points and pieces of each projected interval out of one generator: ``kind``, times a..b, and the place me, mn.

    So an interval is computed, read and projected once, whatever it contributes to.
    """
    df = held(flat, "cuts_", _ordered(cuts))
    at = lambda r: F.col("start_ns") + F.floor(F.col("delta_ns") * r + 0.5).cast("bigint")
    atom = lambda kind, r0, r1, a, b: F.struct(F.lit(kind).alias("kind"), r0.alias("r0"), r1.alias("r1"), a.alias("a"), b.alias("b"))
    start = F.array(atom(_START, F.lit(0.0), F.lit(0.0), F.col("start_ns"), F.col("start_ns")))
    step = lambda i: F.floor(i * F.col("expected_s") * NS + 0.5).cast("bigint")
    missed = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("missing")), lambda i: atom(_MISSED, step(i) / F.col("delta_ns"), step(i) / F.col("delta_ns"), F.col("start_ns") + step(i), F.col("start_ns") + step(i)))
    cut = lambda k: F.element_at("cuts_", k)
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts_") - 1), lambda k: atom(_PIECE, cut(k), cut(k + 1), at(cut(k)), at(cut(k + 1))))
    some = F.when(F.col("missing") > 0, missed.cast(f"array<{_ATOM}>")).otherwise(F.array().cast(f"array<{_ATOM}>"))
    every = F.concat(start.cast(f"array<{_ATOM}>"), some, F.filter(pieces, lambda x: x["a"] < x["b"]).cast(f"array<{_ATOM}>"))
    df = df.select("vessel_class", "mmsi", "stale_start_ns", "start_km", "e0", "n0", "e1", "n1", F.inline(every))
    mid = (F.col("r0") + F.col("r1")) / 2
    return df.withColumns({"me": F.col("e0") + (F.col("e1") - F.col("e0")) * mid, "mn": F.col("n0") + (F.col("n1") - F.col("n0")) * mid})


def _measured(atoms: DataFrame, place: list[str]) -> DataFrame:
    """Atoms with a place, cut at buckets: (bucket, place, vessel_class, mmsi, measures)."""
    buckets = F.when(F.col("kind") == _PIECE, F.sequence(bucket(F.col("a")), bucket(F.col("b") - 1), F.lit(BUCKET_NS))).otherwise(F.array(bucket(F.col("a"))))
    df = atoms.withColumn("bucket", F.explode(buckets))
    lo, hi = F.greatest("a", "bucket"), F.least(F.col("b"), F.col("bucket") + BUCKET_NS)
    stale = F.greatest(F.lit(0), hi - F.greatest(lo, F.col("stale_start_ns"))) / float(NS)
    one = lambda kind: (F.col("kind") == kind).cast("bigint")
    lasting = lambda c: F.when(F.col("kind") == _PIECE, c).otherwise(0.0)
    return df.select("bucket", *place, "vessel_class", "mmsi", one(_START).alias("observed"), one(_MISSED).alias("missing"), lasting((hi - lo) / float(NS)).alias("observed_s"), lasting(stale).alias("stale_s"))


def cell_contributions(intervals: DataFrame) -> DataFrame:
    """(bucket, col, row, vessel_class, mmsi, measures) before they are summed."""
    atoms = _atoms(projected(intervals), _grid_cuts())
    return _measured(atoms.withColumn("col", F.expr(geo.cell("me"))).withColumn("row", F.expr(geo.cell("mn"))), ["col", "row"])


def band_counts(flat: DataFrame) -> DataFrame:
    """The counts of ``band_contributions``, without the durations; ``flat`` are projected intervals, each gone through once."""
    step = F.floor(F.col("i") * F.col("expected_s") * NS + 0.5).cast("bigint")
    df = flat.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("missing")))).withColumn("step_", step)
    ratio = F.col("step_") / F.nullif(F.col("delta_ns"), F.lit(0))
    df = df.withColumn("pe", F.col("e0") + (F.col("e1") - F.col("e0")) * ratio).withColumn("pn", F.col("n0") + (F.col("n1") - F.col("n0")) * ratio)
    df = with_steps(df, geo.from_utm("pe", "pn", "p_lat", "p_lon"), geo.geo_scratch("p_lat"))
    df = within_bands(df, f"CASE WHEN i = 0 THEN start_km ELSE {geo.receiver_km('p_lat', 'p_lon')} END")
    one = lambda c: c.cast("bigint")
    return df.select(bucket(F.col("start_ns") + F.col("step_")).alias("bucket"), "band", "vessel_class", "mmsi", one(F.col("i") == 0).alias("observed"), one(F.col("i") > 0).alias("missing"), F.lit(0.0).alias("observed_s"), F.lit(0.0).alias("stale_s"))


def band_contributions(intervals: DataFrame) -> DataFrame:
    """(bucket, band, vessel_class, mmsi, measures) before they are summed; a start lies where its report does."""
    df = with_steps(_atoms(*_with_circles(projected(intervals))), geo.from_utm("me", "mn", "m_lat", "m_lon"), geo.geo_scratch("m_lat"))
    return _measured(within_bands(df, f"CASE WHEN kind = {_START} THEN start_km ELSE {geo.receiver_km('m_lat', 'm_lon')} END"), ["band"])


def outside_count(intervals: DataFrame) -> DataFrame:
    """Observed and missing points beyond the last band."""
    flat = projected(intervals)
    far = lambda df, km: df.withColumn("km_", F.expr(km)).agg(F.count_if(F.expr(geo.band("km_")).isNull()).alias("n"))
    both = far(flat, "start_km").union(far(missing_positions(flat), geo.receiver_km("p_lat", "p_lon")))
    return both.agg(F.sum("n").alias("outside"))


def facts(contributions: DataFrame, place: list[str], distinct: bool = True) -> DataFrame:
    """Sums by bucket, place and class; with the number of vessels present."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    return contributions.groupBy("bucket", *place, "vessel_class").agg(*sums, *([F.countDistinct("mmsi").alias("vessels")] if distinct else []))


def vessel_days(contributions: DataFrame) -> DataFrame:
    day = contributions.withColumn("day", jst_day(F.col("bucket")))
    return day.groupBy("day", "band", "vessel_class", "mmsi").agg(*[F.sum(m).alias(m) for m in MEASURES])


def presence(contributions: DataFrame, *time: Column, place: tuple[str, ...] = ("band",)) -> DataFrame:
    """Which vessels were present where and when; the base of exact distinct counts at any grain."""
    return contributions.select(*time, *place, "vessel_class", "mmsi").distinct()


def evaluated(df: DataFrame) -> DataFrame:
    """Loss and freshness percentages and what is insufficient about each row."""
    expected = "(observed + missing)"
    return df.withColumns({"loss_pct": F.expr(rates.percent("missing", expected)), "stale_pct": F.expr(rates.percent("stale_s", "observed_s")), "insufficient": F.expr(rates.reasons(expected, "vessels"))})


def period(day: Column, dimension: str) -> Column:
    """Label of a day in DAY, DAY_OF_WEEK, MONTH or YEAR."""
    return {"DAY": F.date_format(day, "yyyy-MM-dd"), "DAY_OF_WEEK": F.upper(F.date_format(day, "EEEE")), "MONTH": F.date_format(day, "yyyy-MM"), "YEAR": F.date_format(day, "yyyy")}[dimension]


def rollup(contributions: DataFrame, dimension: str, place: tuple[str, ...] = ("band",)) -> DataFrame:
    """Measures, distinct vessels and observation days by period; HOUR_OF_DAY is a period too."""
    day = jst_day(F.col("bucket"))
    label = F.lpad(jst_hour(F.col("bucket")).cast("string"), 2, "0") if dimension == "HOUR_OF_DAY" else period(day, dimension)
    df = contributions.withColumn("day", day).withColumn("period", label)
    return evaluated(df.groupBy("period", *place, "vessel_class").agg(*[F.sum(m).alias(m) for m in MEASURES], F.countDistinct("mmsi").alias("vessels"), F.countDistinct("day").alias("days")))
