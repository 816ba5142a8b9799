"""Queries over the driver's tables, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, nmea, rates
from tidewatch.functions.steps import held, with_steps
from tidewatch.operators import calibrate, cube, gaps, ingest, intervals, legacy, metadata, replay, shiplength, stored
from tidewatch.operators import old_decoder as old
from tidewatch.operators.reports import reports_of_events
from tidewatch.sources import store
from tidewatch.sources.work import saved

NS = rates.NS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_of_events(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that summation order doesn't show.

    At four digits halves of whole microseconds are frequent and would go either way: they are moved off the tie.
    """
    shift = 3e-7 if digits == 4 else 0.0
    return df.select(*[F.round(F.col(c) + shift, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.accepted(reports(spark, sf_dir))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.band_contributions(accepted(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.cell_contributions(accepted(spark, sf_dir))


def loss_by_distance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by the distance band of the interval's start and by class."""
    df = accepted(spark, sf_dir).withColumn("band", F.expr(geo.band("start_km"))).where("band is not null")
    df = df.groupBy("band", "vessel_class").agg(F.count("*").alias("observed"), F.sum("missing").alias("missing"), F.countDistinct("mmsi").alias("vessels"))
    return rounded(df.withColumn("loss_pct", F.expr(rates.percent("missing", "observed + missing"))))


def course_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.with_course(intervals.paired(reports(spark, sf_dir))).select("event_id", "mmsi", "kind", "turning")


def report_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = intervals.analyzed(reports(spark, sf_dir))
    return rounded(df.select("event_id", "mmsi", "reason", "expected_s", "actual_s", "missing", "stale_s"))


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.exclusion_counts(intervals.analyzed(reports(spark, sf_dir)))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.run_summary(intervals.analyzed(reports(spark, sf_dir)))


SNAPSHOT_NS = tuple((1_704_067_200 + s) * NS for s in (30 * 3600 + 1234, 3 * 86_400, 5 * 86_400 - 777))


def _displayed(shown: DataFrame, at_ns: int) -> DataFrame:
    return rounded(shown.select(F.lit(at_ns).alias("at_ns"), "mmsi", "vessel_class", "lat", "lon", "direction", "age_s", "expected_s", "state", "visible", F.size("trail").alias("trail_points")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is displayed at three times, over all that came before."""
    rows = reports(spark, sf_dir)
    shown = [_displayed(replay.displayed(replay.states_at(rows, t), replay.trails(rows, t), t), t) for t in SNAPSHOT_NS]
    return shown[0].union(shown[1]).union(shown[2])


def replay_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same times reached by a seek in the replay of their days, which begin without states."""
    index = replay.ReplayIndex(spark, store.new_store_path(spark, "replay"))
    index.build(reports(spark, sf_dir))
    shown = [_displayed(index.seek(t), t) for t in SNAPSHOT_NS]
    return shown[0].union(shown[1]).union(shown[2])


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir).select("event_id", "lat", "lon")
    df = with_steps(df, geo.to_utm("lat", "lon", "e", "n") + geo.from_utm("e", "n", "lat2", "lon2"))
    return df.select("event_id", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), F.expr(geo.cell("e")).alias("col"), F.expr(geo.cell("n")).alias("row"), F.round(F.abs(F.col("lat2") - F.col("lat")) + F.abs(F.col("lon2") - F.col("lon")), 7).alias("error"))


def receiver_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir).withColumn("km", F.expr(geo.receiver_km("lat", "lon")))
    y, x = geo.destination("lat", "lon", "10e0", "45e0")
    my, mx = geo.mercator("lat", "lon")
    return rounded(df.select("event_id", "km", F.expr(geo.band("km")).alias("band"), F.expr(y).alias("lat_10km"), F.expr(x).alias("lon_10km"), F.round(F.expr(my), 3).alias("mercator_x"), F.round(F.expr(mx), 3).alias("mercator_y")))


def bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube.split_buckets(accepted(spark, sf_dir), "start_ns", "ts_ns")
    return rounded(df.groupBy("bucket", "vessel_class").agg(F.count("*").alias("n"), F.sum("part_s").alias("seconds")))


def missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube.missing_positions(cube.projected(accepted(spark, sf_dir)))
    return df.groupBy("mmsi").agg(F.count("*").alias("n"), F.sum(F.col("at_ns") % 1_000_003).alias("time_digest"), F.round(F.avg("p_lat"), 6).alias("lat"), F.round(F.avg("p_lon"), 6).alias("lon"))


def grid_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube.grid_pieces(cube.projected(accepted(spark, sf_dir)))
    return df.groupBy("mmsi").agg(F.count("*").alias("pieces"), F.sum(F.col("piece_end_ns") - F.col("piece_ns")).alias("ns"), F.countDistinct("col", "row").alias("cells"))


def interval_nanoseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid allocation neither loses nor doubles time."""
    pieces = grid_allocation(spark, sf_dir).select("mmsi", "ns")
    whole = accepted(spark, sf_dir).groupBy("mmsi").agg(F.sum("delta_ns").alias("whole"))
    return pieces.join(whole, "mmsi").select("mmsi", "ns", "whole", (F.col("ns") == F.col("whole")).alias("same"))


def cell_metric_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube.facts(cells(spark, sf_dir), ["col", "row"]), 4)


def distance_metric_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube.facts(bands(spark, sf_dir), ["band"]), 4)


def vessel_day_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube.vessel_days(bands(spark, sf_dir)), 4)


def heat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over all time and both classes, with their loss class and centre."""
    df = cells(spark, sf_dir).groupBy("col", "row").agg(*[F.sum(m).alias(m) for m in cube.MEASURES], F.countDistinct("mmsi").alias("vessels"))
    df = cube.evaluated(df).withColumn("heat", F.expr(rates.heat_class("round(loss_pct, 9)")))
    df = with_steps(df, [("ce", f"(col + 0.5e0) * {geo.GRID_M}e0"), ("cn", f"(row + 0.5e0) * {geo.GRID_M}e0"), *geo.from_utm("ce", "cn", "lat", "lon")]).withColumn("km", F.expr(geo.receiver_km("lat", "lon")))
    return rounded(df.select("col", "row", *cube.MEASURES, "vessels", "loss_pct", "stale_pct", "insufficient", "heat", "lat", "lon", "km"), 4)


def _rollup(dimension: str, place: tuple[str, ...] = ("band",)) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(cube.rollup(bands(spark, sf_dir), dimension, place), 4)


def distance_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band by hour; the rate only where there is enough."""
    df = cube.rollup(bands(spark, sf_dir), "HOUR_OF_DAY")
    return rounded(df.select("period", "band", "vessel_class", "observed", "missing", "vessels", F.when(F.col("insufficient") == "", F.col("loss_pct")).alias("loss_pct")), 4)


def vessel_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct vessels at three grains, always from presence."""
    df = bands(spark, sf_dir)
    day = cube.presence(df, cube.jst_day(F.col("bucket")).alias("day"))
    return day.groupBy("band", "vessel_class").agg(F.countDistinct("mmsi").alias("vessels"), F.count("*").alias("vessel_days"), F.countDistinct("day").alias("days"))


def daily_distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled loss over all days and quartiles of the sufficient daily rates; bands without any are left out."""
    df = cube.rollup(bands(spark, sf_dir), "DAY")
    ok = F.when(F.col("insufficient") == "", F.col("loss_pct"))
    q = F.percentile(ok, F.array(F.lit(0.25), F.lit(0.75)))
    df = df.groupBy("band", "vessel_class").agg((F.sum("missing") * 100.0 / F.sum(F.col("observed") + F.col("missing"))).alias("pooled_pct"), q.alias("q"), F.count(ok).alias("days"))
    return rounded(df.where("days > 0").select("band", "vessel_class", "pooled_pct", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "days"), 4)


def _stored(spark: SparkSession, sf_dir: str) -> store.ResultStore:
    """Facts and presence of all days, published as a run a day, twice: the first runs are superseded and hold doubled facts."""
    df = bands(spark, sf_dir).withColumn("day", cube.jst_day(F.col("bucket")))
    kept = store.ResultStore(spark, store.new_store_path(spark, "runs"))
    sums = [F.sum(m).alias(m) for m in cube.MEASURES]
    df.groupBy("day", "bucket", "band", "vessel_class", "mmsi").agg(*sums).write.parquet(f"{kept.path}/work")
    vessels = spark.read.parquet(f"{kept.path}/work")
    hour = F.col("bucket") - F.pmod(F.col("bucket"), F.lit(3600 * NS))
    present = vessels.select("day", hour.alias("hour_ns"), "band", "vessel_class", "mmsi").distinct()
    facts = vessels.groupBy("day", "bucket", "band", "vessel_class").agg(*sums)
    started = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    for turn in (1, 2):
        name = F.concat(F.lit(f"r{turn}-"), F.col("day").cast("string")).alias("run_id")
        runs = vessels.select("day").distinct().select(name, "day", F.lit("f").alias("fingerprint"), F.lit("rx").alias("receiver"), F.lit("p").alias("profile"), (started + turn).alias("started_us"), F.when(F.dayofmonth("day") % 2 == 0, started + 3_600_000_000).alias("ended_us"))
        doubled = facts if turn == 2 else facts.withColumns({m: F.col(m) * 2 for m in cube.MEASURES})
        kept.publish_days(runs, {"distance_5m": doubled.select(name, *[c for c in facts.columns if c != "day"]), "presence": present.select(name, *[c for c in present.columns if c != "day"])})
    return kept


EXCLUDED_DAYS = ("2024-01-03",)


def _stored_rollup(dimension: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _stored(spark, sf_dir)
        runs = stored.included(kept.runs(), "2023-12-31", "2024-12-31", EXCLUDED_DAYS)
        return rounded(stored.rollup(kept.read("distance_5m"), kept.read("presence"), runs, dimension), 4)

    return run


def stored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day of a range contributes to stored results."""
    return stored.day_states(_stored(spark, sf_dir).runs(), "2023-12-30", "2024-01-12", EXCLUDED_DAYS)


#: A day with a second active run, which a dataset doesn't take.
DOUBLED_DAY = "2024-01-04"


def _dataset_days(kept: store.ResultStore) -> DataFrame:
    runs = kept.runs()
    again = runs.where(F.col("day") == F.lit(DOUBLED_DAY).cast("date")).withColumn("run_id", F.concat("run_id", F.lit("-again")))
    return stored.run_days(runs.unionByName(again), "2023-12-31", "2024-01-12", EXCLUDED_DAYS, "rx", "p")


def stored_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and vessels by band and class out of stored runs: an excluded day and one with two runs are left out."""
    kept = _stored(spark, sf_dir)
    rows = stored.calibration_rows(kept.read("distance_5m"), kept.read("presence"), _dataset_days(kept))
    return rows.select("day", "band", "vessel_class", "observed", "missing", F.size("vessels").alias("vessels"), F.aggregate("vessels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mmsi_sum"))


def stored_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled measures and daily rates by band and class out of the same runs."""
    kept = _stored(spark, sf_dir)
    rows = stored.observed_validation(kept.read("distance_5m"), kept.read("presence"), _dataset_days(kept))
    shown = [f(F.col(f"daily_{c}")).alias(f"{c}_{n}") for c in ("loss_pct", "stale_pct") for n, f in (("days", F.size), ("least", F.array_min), ("most", F.array_max), ("first", lambda a: F.get(a, F.lit(0))))]
    return rounded(rows.select("band", "vessel_class", *cube.MEASURES, "days", "vessels", *shown), 4)


def runs_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published runs, superseded ones too, that reach into half a day."""
    start = 1_704_153_600_000_000
    return stored.overlapping(_stored(spark, sf_dir).every_run(), start + 1_800_000_000, start + 86_400_000_002).select("run_id", "day", "started_us", "ended_us")


def current_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stored.current(cube.facts(bands(spark, sf_dir), ["band"], distinct=False)), 4)


def outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.outside_count(accepted(spark, sf_dir))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt over all tasks: a file has few row groups, and what sentences cost would stay with the tasks that read them."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").repartition("event_id")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a sentence of type 1, 2, 3 or 18."""
    df = reports_of_events(_dealt(spark, sf_dir))
    lat, lon = F.round(F.col("lat") * 600000), F.round(F.col("lon") * 600000)
    sog, cog, head = F.round(F.col("sog") * 10), F.round(F.col("cog") * 10), F.coalesce("heading", F.lit(511.0))
    first, place = [(F.col("message_type"), 6), (0, 2), (F.col("mmsi"), 30)], [(sog, 10), (0, 1), (lon, 28), (lat, 27), (cog, 12), (head, 9)]
    a = nmea.laid_out(*first, (F.coalesce("nav_status", F.lit(15)), 4), (0, 8), *place, (0, 31))
    mode = F.when(F.col("class_b_mode") == "CARRIER_SENSE", 1).otherwise(0)
    c = nmea.laid_out(*first, (0, 8), *place, (0, 8), (mode, 1), (0, 4), (1, 1), (0, 21))
    df = held(df, "payload_", F.when(F.col("message_type") == 18, c).otherwise(a))
    return held(df, "sent", nmea.sentence(F.col("payload_"))).drop("payload_")


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sentences, read back through envelope, checksum and payload decoding."""
    framed = nmea.with_envelope(_encoded(spark, sf_dir).select("event_id", F.col("sent").alias("sentence"))).drop("tag", "total", "number", "channel", "sequence_id")
    read = nmea.decoded(framed.where("code is null").drop("code"))
    return rounded(read.where("code is null").select("event_id", "message_type", "mmsi", "vessel_class", "sog", "cog", "heading", "nav_status", "lat", "lon"))


def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum of each event's properties, and the state of a sentence that carries it, lacks it or has another."""
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("AIVDM,"), "event_type", "props").alias("body"))
    right = nmea.checksum(F.col("body"))
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("!"), "body")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("!"), F.col("body"), F.lit("*0"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("!x"), F.col("body"), F.lit("*"), right)).otherwise(F.concat(F.lit("!"), F.col("body"), F.lit("*"), right))
    return df.select("event_id", right.alias("checksum"), nmea.checksum_state(s).alias("state"))


def dedup_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within a second of the previous occurrence, on time squeezed so that they happen."""
    df = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("sequence"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) * 5).alias("ns"))
    return ingest.deduplicated(df, ("event_type",), "ns").groupBy("event_type").agg(F.count("*").alias("kept"), F.sum("sequence").alias("ids"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sentences of one or two parts, on squeezed time: parts lost, swapped, repeated, changed or seconds apart."""
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 50_000).cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (ms * 1_000_000).alias("ns"), (F.col("event_id") % 8).alias("way"))

    def part(*ways: int, number: int = 1, total: int = 2, after_ms: int = 0, mark: str = "", place: int = 0) -> Column:
        made = F.struct((F.col("ns") + after_ms * 1_000_000).alias("received_ns"), (F.col("event_id") * 4 + place).alias("sequence"), F.lit(total).alias("total"), F.lit(number).alias("number"), F.concat("event_type", F.lit(f"{number}{mark}")).alias("payload"))
        return F.when(F.col("way").isin(*ways), made)

    sent = F.array_compact(F.array(
        part(0, 3, 4, 5, 7), part(1, 2, number=2), part(6, total=1), part(2, after_ms=100, place=1), part(3, after_ms=50, place=1), part(4, after_ms=50, place=1, mark="x"), part(1, number=2, after_ms=50, place=1, mark="x"),
        part(3, 4, number=2, after_ms=100, place=2), part(5, number=2, after_ms=9000, place=2), part(7, number=2, after_ms=100, place=2)))
    df = e.select("event_id", "user_id", F.explode(sent).alias("p")).select("event_id", "user_id", "p.*")
    fill = F.when((F.col("total") == 2) & (F.col("number") == 2), 2).otherwise(0)
    return df.select("received_ns", "sequence", F.lit("rx").alias("source_id"), F.lit("!AIVDM").alias("tag"), "total", "number", (F.col("event_id") % 10).cast("string").alias("sequence_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("channel"), "payload", fill.alias("fill_bits"))


def fragment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every sentence: its whole payload, or why its parts came to nothing and when that was noticed."""
    return ingest.assembled(_fragments(spark, sf_dir)).select("received_ns", "sequence", "channel", "payload", "fill_bits", "code")


def _stamp(ns: str) -> Column:
    """Time of a log line. Nanoseconds are divided as integers: as doubles an eighth of the whole milliseconds came out one too early."""
    return F.date_format(F.timestamp_micros(F.expr(f"{ns} div 1000") + ingest.JST_US), "yyyyMMddHHmmssSSS")


def log_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines written from events, parsed, assembled, decoded and de-duplicated; counts by vessel."""
    df = _encoded(spark, sf_dir)
    stamp = _stamp("ts_ns")
    lines = df.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 50 == 0, F.lit("broken line")).otherwise(F.concat(stamp, F.lit(" "), F.col("sent"))).alias("value"))
    events, _ = ingest.events_of_lines(lines)
    return events.groupBy("mmsi").agg(F.count("*").alias("n"))


def log_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _encoded(spark, sf_dir)
    stamp = _stamp("ts_ns")
    lines = df.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 50 == 0, F.lit("broken line")).otherwise(F.concat(stamp, F.lit(" "), F.regexp_replace("sent", "[*]..$", "*zz"))).alias("value"))
    _, found = ingest.events_of_lines(lines)
    return found.select("code", "n")


def log_replay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three files merged by day: number, first and last time, and a digest of the order."""
    df = reports(spark, sf_dir)
    lines = df.select((F.col("event_id") % 3).cast("string").alias("file"), F.col("event_id").alias("line_no"), F.concat(_stamp("ts_ns"), F.lit(" !AIVDM,x")).alias("value"))
    merged = ingest.replay_order(ingest.parsed_lines(lines).where("code is null"))
    days = merged.groupBy("day").agg(F.count("*").alias("n"), F.min("received_ns").alias("first_ns"), F.max("received_ns").alias("last_ns"), F.sum(F.col("ordinal") * (F.col("line_no") % 1009)).alias("order_digest"))
    return days.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))


def _static_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, part, sent): static updates as type 5 in two parts, as type 24 part A, or as its part B."""
    df = _updates_of(_dealt(spark, sf_dir)).withColumn("kind_", F.col("seq") % 3).withColumn("name", F.coalesce("vessel_name", F.concat(F.lit("NO NAME "), (F.col("seq") % 100).cast("string"))))
    letters = nmea.text_numbers
    call, name, port = letters(F.concat(F.lit("C"), (F.col("seq") % 1000).cast("string")), 42), letters(F.col("name"), 120), letters(F.concat(F.lit("PORT-"), (F.col("seq") % 50).cast("string")), 120)
    bow = F.floor(F.col("seq") % 400 / 3)
    size = [(bow, 9), (F.col("seq") % 400 - bow, 9)]
    head = lambda t: [(t, 6), (0, 2), (F.col("mmsi"), 30)]
    five = nmea.laid_out(*head(5), (0, 2), (F.col("seq") % 100000, 30), *call, *name, (F.col("seq") % 100, 8), *size, (0, 44), *port, (0, 2))
    part_a, part_b = nmea.laid_out(*head(24), (0, 2), *name, (0, 8)), nmea.laid_out(*head(24), (1, 2), (F.col("seq") % 100, 8), (0, 42), *call, *size, (0, 18))
    df = held(df, "payload_", F.when(F.col("kind_") == 0, five).when(F.col("kind_") == 1, part_a).otherwise(part_b))
    mark = F.col("seq") % 10
    first, second = nmea.sentence(F.left("payload_", F.lit(60)), None, 2, 1, mark), nmea.sentence(F.substring("payload_", 61, 20), F.lit("2"), 2, 2, mark)
    whole = F.array(F.when(F.col("kind_") == 0, first).otherwise(nmea.sentence(F.col("payload_"))), F.when(F.col("kind_") == 0, second))
    return df.select("seq", "ts_ns", F.posexplode(F.array_compact(whole)).alias("part", "sent"))


def static_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, call signs, sizes and destinations as log lines, some in two parts, read back through all input steps; ``seq`` is the line's file."""
    df = _static_sentences(spark, sf_dir)
    lines = df.select(F.col("seq").cast("string").alias("file"), F.col("part").alias("line_no"), F.concat(_stamp("ts_ns"), F.lit(" "), "sent").alias("value"))
    # every update is a source of its own here, so that neither parts nor repeats of different ones meet
    found = ingest.outcomes(lines, F.col("file"))
    shown = ["imo", "call_sign", "vessel_name", "ship_type", "ship_length_m", "destination"]
    return found.where("code is null").select(F.split("sequence", ":")[0].cast("bigint").alias("seq"), "message_type", "mmsi", "vessel_class", *shown)


def old_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports, those of type 18 cut to 133 bits, and static reports in two parts cut after various fields, all with a wrong checksum, through the older decoder."""
    b, text_ = nmea.to_bits, nmea.text_bits
    zero = lambda n: F.lit("0" * n)
    e = reports(spark, sf_dir)
    lat, lon, head = F.round(F.col("lat") * 600000), F.round(F.col("lon") * 600000), F.coalesce("heading", F.lit(511.0))
    first = F.concat(b(F.col("message_type"), 6), zero(2), b(F.col("mmsi"), 30))
    place = F.concat(b(F.round(F.col("sog") * 10), 10), zero(1), b(lon, 28), b(lat, 27), b(F.round(F.col("cog") * 10), 12), b(head, 9))
    bits = F.when(F.col("message_type") == 18, F.concat(first, zero(8), place)).otherwise(F.concat(first, b(F.coalesce("nav_status", F.lit(15)), 4), zero(8), place, zero(31)))
    p = held(held(e, "bits_", bits), "payload_", nmea.armoured(F.col("bits_")))
    fill = F.when(F.col("message_type") == 18, F.lit("5")).otherwise(F.lit("0"))
    positions = p.select(F.col("ts_ns").alias("received_ns"), (F.col("seq") * 4).alias("sequence"), F.concat(F.lit("!AIVDM,1,1,,A,"), "payload_", F.lit(","), fill, F.lit("*zz")).alias("sentence"))
    u = _updates(spark, sf_dir)
    letter = F.char(F.lit(65) + F.col("seq") % 26)
    name = F.coalesce("vessel_name", F.concat(F.lit("NO-NAME "), letter))
    five = F.concat(b(F.lit(5), 6), zero(2), b(F.col("mmsi"), 30), zero(2), b(F.col("seq") % 7, 30), text_(F.concat(F.lit("C"), letter), 42), text_(name, 120), b(F.col("seq") % 100, 8), b(F.col("seq") % 400, 9), zero(9), zero(44), text_(F.concat(F.lit("PORT "), letter), 120), zero(2))
    cut = F.element_at(F.array(*[F.lit(n) for n in (432, 276, 240, 234, 114, 72, 66)]), (F.col("seq") % 7 + 1).cast("int"))
    s = held(held(u, "bits_", F.rpad(F.substring(five, F.lit(1), cut), cut, "0")), "payload_", nmea.armoured(F.col("bits_")))
    half = F.floor(F.length("payload_") / 2).cast("int")
    part = lambda k, body: F.struct(F.lit(k).alias("k"), F.concat(F.lit(f"!AIVDM,2,{k},"), (F.col("seq") % 10).cast("string"), F.lit(",B,"), body, F.lit(",0*zz")).alias("text"))
    both = F.array(part(1, F.substring("payload_", F.lit(1), half)), part(2, F.substring("payload_", half + 1, F.length("payload_"))))
    statics = s.select("ts_ns", "seq", F.explode(both).alias("x")).select(F.col("ts_ns").alias("received_ns"), (F.col("seq") * 4 + F.col("x.k")).alias("sequence"), F.col("x.text").alias("sentence"))
    found = old.messages(positions.unionByName(statics).withColumn("source_id", F.lit("rx")))
    shown = ["message_type", "mmsi", "nav_status", "sog", "cog", "heading", "lat", "lon", "imo", "call_sign", "vessel_name", "ship_type", "ship_length_m", "destination"]
    return rounded(found.select(F.floor(F.col("sequence") / 4).alias("seq"), *shown))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static updates derived from events: sparse lengths and names."""
    return _updates_of(table(spark, sf_dir, "events"))


def _updates_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", (F.col("user_id") % 25 + 431000000).cast("int").alias("mmsi"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    length = F.when(F.col("event_id") % 3 == 0, ((F.col("mmsi").cast("bigint") * 29 + F.floor(F.col("event_id") / 400) * 60) % 520).cast("int"))
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("V"), (F.col("event_id") % 14).cast("string")))
    return e.select("mmsi", "ts_ns", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "UNKNOWN").when(F.col("mmsi") % 5 == 0, "B").otherwise("A").alias("vessel_class"), length.alias("ship_length_m"), name.alias("vessel_name"))


def metadata_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.versions(metadata.merged(_updates(spark, sf_dir)))


def metadata_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and name that were valid at each report."""
    at = reports(spark, sf_dir).select("event_id", "mmsi", F.col("ts_ns").alias("at_ns"))
    history = metadata.versions(metadata.merged(_updates(spark, sf_dir)))
    return metadata.effective(history, at).select("event_id", "mmsi", "ship_length_m", "vessel_name")


def first_known_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.first_known_length(_updates(spark, sf_dir))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updates(spark, sf_dir).where("ship_length_m is not null").select("mmsi", F.col("ts_ns").alias("valid_from"), "ship_length_m").groupBy("mmsi", "valid_from").agg(F.max("ship_length_m").alias("ship_length_m"))


def _report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = accepted(spark, sf_dir).withColumn("band", F.expr(geo.band("start_km"))).where("band is not null")
    return df.withColumn("day", cube.jst_day(F.col("start_ns")))


def ship_length_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shiplength.reach(_report_days(spark, sf_dir).select("day", "band", "vessel_class", "mmsi").distinct(), _lengths(spark, sf_dir)))


def ship_length_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _report_days(spark, sf_dir).groupBy("day", "band", "vessel_class", "mmsi").agg(F.count("*").alias("observed"), F.sum("missing").alias("missing"), F.sum("actual_s").alias("observed_s"), F.sum("stale_s").alias("stale_s"))
    return rounded(shiplength.performance(days, _lengths(spark, sf_dir)), 4)


def ship_length_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shiplength.coverage(_report_days(spark, sf_dir), _lengths(spark, sf_dir))


def daily_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = intervals.analyzed(reports(spark, sf_dir)).withColumn("day", cube.jst_day(F.col("ts_ns")))
    codes = df.groupBy("day", F.coalesce(F.concat(F.lit("INTERVAL_"), "reason"), F.lit("ACCEPTED")).alias("code")).agg(F.count("*").alias("n"))
    facts = df.select("day", cube.bucket(F.col("ts_ns")).alias("bucket"))
    return shiplength.daily_quality(facts, codes, df.select("day", "mmsi"), "2023-12-31", "2024-01-09")


def _calibration_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_days(spark, sf_dir).groupBy("day", "band", "vessel_class", "mmsi").agg(F.count("*").alias("observed"), F.sum("missing").alias("missing"))


def pooled_jeffreys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.pooled(_calibration_days(spark, sf_dir)))


def model_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without bootstrap bounds, which SQL can express."""
    return rounded(calibrate.parameters(calibrate.pooled(_calibration_days(spark, sf_dir))))


def model_with_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _calibration_days(spark, sf_dir)
    return rounded(calibrate.parameters(calibrate.pooled(days), calibrate.intervals_by_bootstrap(days)))


def _ideal(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = intervals.analyzed(reports(spark, sf_dir), ("mmsi", "vessel_class"))
    lost = cube.missing_positions(cube.projected(everything.where("reason is null")))
    return calibrate.ideal_transmissions(everything, lost)


def ideal_transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ideal(spark, sf_dir).groupBy("mmsi", "vessel_class", "origin").agg(F.count("*").alias("n"), F.max("ordinal").alias("last_ordinal"), F.sum(F.col("planned_ns") % 1_000_003).alias("time_digest"))


def deterministic_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir)
    day = F.floor(F.col("ts_ns") / 86_400_000_000_000)
    return df.select("event_id", F.round(calibrate.uniform(7, 1, 2, day, F.col("mmsi"), F.col("vessel_class"), F.col("ts_ns"), F.lit(0)), 12).alias("u"))


def _model(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    return calibrate.parameters(calibrate.pooled(days)), calibrate.class_baseline(days)


def reception_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _model(_calibration_days(spark, sf_dir))
    t = _ideal(spark, sf_dir)
    day = F.floor(F.col("planned_ns") / 86_400_000_000_000)
    got = calibrate.decided(t, model, calibrate.uniform(7, 1, 2, day, F.col("mmsi"), F.col("vessel_class"), F.col("planned_ns"), F.col("ordinal")))
    counts = got.groupBy("vessel_class", "decision").agg(F.count("*").alias("n"))
    cuts = calibrate.received_with_boundaries(got).groupBy("vessel_class").agg(F.count_if("boundary").alias("boundaries"))
    return counts.join(cuts, "vessel_class")


def validation_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = saved(_calibration_days(spark, sf_dir), "calibration-days")
    model, baseline = _model(days)
    summary = calibrate.summarized(calibrate.simulated_counts(calibrate.replayed(reports(spark, sf_dir)), model, baseline, 5))
    daily = days.groupBy("day", "band", "vessel_class").agg(F.sum("observed").alias("o"), F.sum("missing").alias("m")).withColumn("pct", F.expr(rates.percent("m", "o + m")))
    q = F.percentile("pct", F.array(F.lit(0.025), F.lit(0.975)))
    observed = daily.groupBy("band", "vessel_class").agg(F.sum(F.col("o") + F.col("m")).alias("expected"), (F.sum("m") * 100.0 / F.sum(F.col("o") + F.col("m"))).alias("loss_pct"), q.alias("q"))
    cells_ = calibrate.compared(observed.select("band", "vessel_class", "expected", "loss_pct", F.col("q")[0].alias("day_low"), F.col("q")[1].alias("day_high")), summary)
    return rounded(calibrate.weighted_error(cells_))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = intervals.with_course(intervals.paired(reports(spark, sf_dir))).withColumn("expected_here", F.expr(rates.expected_seconds()))
    return legacy.category_intervals(df)


def legacy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.distance_bins(_legacy(spark, sf_dir)))


def legacy_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.vessel_totals(_legacy(spark, sf_dir), legacy.LEAST_MESSAGES))


def legacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.across_vessels(legacy.vessel_totals(_legacy(spark, sf_dir), legacy.LEAST_MESSAGES)))


def legacy_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.interval_diagnostics(_legacy(spark, sf_dir)))


def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.gap_histogram(_legacy(spark, sf_dir)))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = intervals.with_course(intervals.paired(reports(spark, sf_dir))).withColumn("expected_here", F.expr(rates.expected_seconds()))
    # every 40th message bears the time of an earlier one, as after a step of the clock
    return gaps.message_gaps(df.withColumn("ts_ns", F.when(F.col("seq") % 40 == 7, F.col("ts_ns") - 400 * NS).otherwise(F.col("ts_ns"))))


def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_totals(_gaps(spark, sf_dir))


def gap_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.expected_histogram(_gaps(spark, sf_dir))


def gap_class_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.class_b_groups(_gaps(spark, sf_dir))


def type5_asof_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static updates with the distance of the latest position before them."""
    static = _updates(spark, sf_dir).withColumn("ts_ns", F.floor((F.col("ts_ns") - 1_704_067_200_000_000_000) / 5).cast("bigint") + 1_704_067_200_000_000_000)
    dynamic = reports(spark, sf_dir).withColumn("km", F.expr(geo.receiver_km("lat", "lon")))
    return rounded(legacy.static_positions(static, dynamic).select("seq", "mmsi", "km"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, category and vessel, with days spread over the whole range of events."""
    df = _legacy(spark, sf_dir).withColumn("day", F.date_add("start_day", (F.col("mmsi") % 25 * 9).cast("int")))
    return df.groupBy("day", "category", "mmsi").agg(F.count("*").alias("observed"), F.sum("loss").alias("loss"))


def _daily_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _daily(spark, sf_dir).groupBy("day", "category").agg(F.sum("observed").alias("observed"), F.sum("loss").alias("loss"), F.countDistinct("mmsi").alias("vessels"))
    return df.withColumn("loss_pct", F.expr(rates.percent("loss", "observed + loss")))


def _by_period(key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(legacy.by_period(_daily(spark, sf_dir), key))


def rolling_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = legacy.rolling(legacy.rolling(_daily_rates(spark, sf_dir), 7, 4), 30, 15)
    return rounded(df.select("day", "category", "loss_pct", "rolling_7", "rolling_30"))


def monthly_of_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.monthly_of_daily(_daily_rates(spark, sf_dir)))


def spearman_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.trends(_daily_rates(spark, sf_dir)))


def weekday_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.weekday_means(_daily_rates(spark, sf_dir)))


def matched_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sums of the days up to the third of July of each year."""
    return rounded(legacy.by_period(legacy.matched_period(_daily(spark, sf_dir), "07-03"), "YEAR"))


def _daily_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _legacy(spark, sf_dir).withColumn("bin", F.floor(F.col("start_km") / 10).cast("int")).withColumn("day", F.date_add("start_day", (F.col("mmsi") % 3 * 366).cast("int")))
    return df.groupBy("day", "category", "bin", "mmsi").agg(F.count("*").alias("observed"), F.sum("loss").alias("loss"))


def year_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.year_comparison(_daily_bins(spark, sf_dir)))


def bin_metrics_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins on two weekdays and on all days."""
    df = _daily_bins(spark, sf_dir)
    shown = [legacy.bin_metrics(df, d).select(F.lit(d).alias("weekday"), "*") for d in ("ALL", "TUESDAY", "SUNDAY")]
    return rounded(shown[0].union(shown[1]).union(shown[2]))


def overall_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each year, bins put together."""
    return rounded(legacy.overall_metrics(_daily_bins(spark, sf_dir).withColumn("year", F.year("day")), keys=("year",)))


def research_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years by category and bin."""
    return rounded(legacy.by_period(_daily_bins(spark, sf_dir), "YEAR", "bin"))


def position_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.density(reports(spark, sf_dir))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        loss_by_distance_class, course_state, report_intervals, exclusion_counts, run_summary, snapshot, projection, receiver_distance, bucket_split, missing_positions, grid_allocation, interval_nanoseconds, replay_seek, gap_totals, gap_expected, gap_class_b, stored_calibration, stored_validation,
        cell_metric_5m, distance_metric_5m, vessel_day_metric, heat_cells, distance_hour, vessel_presence, daily_distance_summary, outside_range, decode_roundtrip, checksum, dedup_1s, fragment_outcomes, old_decoder, log_ingest, log_diagnostics, log_replay_days, static_roundtrip,
        metadata_versions, metadata_as_of, ship_length_reach, ship_length_performance, ship_length_coverage, daily_quality, pooled_jeffreys, model_parameters, model_with_bootstrap, ideal_transmissions,
        deterministic_uniform, reception_decisions, validation_mae, legacy_bins, legacy_vessels, legacy_summary, legacy_diagnostics, gap_histogram, type5_asof_distance, rolling_7_30, monthly_of_daily, spearman_trend,
        year_comparison, bin_metrics_by_weekday, overall_by_year, research_bins, position_density, stored_days, runs_overlapping, current_aggregate, first_known_length, weekday_means, matched_years,
    )
}
ALL |= {f"rollup_{d.lower()}": _rollup(d) for d in ("DAY", "DAY_OF_WEEK", "MONTH", "YEAR", "HOUR_OF_DAY")}
ALL |= {f"research_{k.lower()}": _by_period(k) for k in legacy.PERIOD_KEYS}
ALL |= {f"stored_rollup_{d.lower()}": _stored_rollup(d) for d in ("DAY", "DAY_OF_WEEK", "MONTH", "HOUR_OF_DAY")}
