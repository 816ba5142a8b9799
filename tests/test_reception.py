import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, nmea, rates
from tidewatch.functions.steps import with_steps
from tidewatch.operators import calibrate, cube, ingest, intervals, metadata, shiplength
from tidewatch.plans import queries
from tidewatch.sources import logs, store, tables
from tidewatch.streaming import live

NS = rates.NS


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first().v


@pytest.mark.parametrize(
    ("args", "want"),
    [(("'A'", "14.0e0", "0", "false", "null"), 10), (("'A'", "14.0e0", "0", "true", "null"), 10 / 3), (("'A'", "14.1e0", "0", "true", "null"), 2), (("'A'", "23.0e0", "0", "false", "null"), 6), (("'A'", "23.1e0", "0", "false", "null"), 2),
     (("'A'", "CAST(null AS double)", "1", "false", "null"), 180), (("'A'", "3.0e0", "5", "false", "null"), 180), (("'A'", "3.1e0", "1", "false", "null"), 10), (("'A'", "CAST(null AS double)", "0", "false", "null"), 10),
     (("'B'", "2e0", "null", "true", "'CARRIER_SENSE'"), 180), (("'B'", "20e0", "null", "true", "'SELF_ORGANIZING'"), 5), (("'B'", "24e0", "null", "false", "'CARRIER_SENSE'"), 30)],
)
def test_expected_seconds(spark, args, want):
    assert value(spark, rates.expected_seconds(*args)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("actual", "expected", "want"), [(361, 360, 0), (539.999, 360, 0), (540, 360, 1), (2.51, 2, 0), (3, 2, 1), (100, 10, 9)])
def test_losses(spark, actual, expected, want):
    assert value(spark, rates.losses(f"{actual}e0", f"{expected}e0")) == want


def test_distance_projection_and_bands(spark):
    assert value(spark, geo.haversine_km("0e0", "0e0", "0e0", "1e0")) == pytest.approx(111.195, abs=1e-3)
    df = spark.createDataFrame([(0.0, 135.0), (34.68, 135.20)], "lat double, lon double")
    a, b = with_steps(df, geo.to_utm("lat", "lon", "e", "n") + geo.from_utm("e", "n", "y", "x")).orderBy("lat").collect()
    assert (a.e, a.n) == pytest.approx((500_000, 0), abs=1e-3) and (b.y, b.x) == pytest.approx((34.68, 135.20), abs=1e-8)
    assert [value(spark, geo.band(f"{k}")) for k in ("0e0", "5e0", "70e0", "70.0001e0")] == [0, 1, 13, None]
    assert [value(spark, geo.cell(f"{k}")) for k in ("500000e0", "499999.9e0", "3800000e0")] == [250, 249, 1900]


def test_grid_and_ring_allocation(spark):
    df = spark.createDataFrame([(0, 100 * NS, 500.0, 500.0, 4500.0, 500.0)], "start_ns bigint, delta_ns bigint, e0 double, n0 double, e1 double, n1 double")
    got = [(r.col, (r.piece_end_ns - r.piece_ns) / NS) for r in cube.grid_pieces(df).orderBy("piece_ns").collect()]
    assert got == [(0, 37.5), (1, 50.0), (2, 12.5)]
    ce, cn = cube.receiver_utm()
    ring = spark.createDataFrame([(0, 100 * NS, ce + 1000, cn, ce + 11_000, cn)], df.schema)
    got = [(r.band, (r.piece_end_ns - r.piece_ns) / NS) for r in cube.ring_pieces(ring).orderBy("piece_ns").collect()]
    assert got == [(0, 40.0), (1, 50.0), (2, 10.0)]
    start = 1_788_447_780 * NS
    parts = cube.split_buckets(spark.createDataFrame([(start, start + 400 * NS)], "a bigint, b bigint"), "a", "b")
    assert [r.part_s for r in parts.orderBy("bucket").collect()] == [120.0, 280.0]
    assert cube.split_buckets(spark.createDataFrame([(start, start)], "a bigint, b bigint"), "a", "b").count() == 0


REPORT = "mmsi int, vessel_class string, class_b_mode string, ts_ns bigint, sog double, cog double, heading double, nav_status int, lat double, lon double, seq bigint"


def reports(spark, rows):
    return spark.createDataFrame([(1, c, m, int(t * NS), s, g, h, n, y, x, k) for k, (c, m, t, s, g, h, n, y, x) in enumerate(rows)], REPORT)


def one(t, heading=None, cog=None, sog=5.0, lat=34.68, cls="A", mode=None):
    return (cls, mode, t, sog, cog, heading, 0, lat, 135.2)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([one(0, 0.0), one(10, 6.0), one(20, 6.0), one(41, 6.0)], [False, True, True, False]), ([one(0, 359.0), one(10, 1.0)], [False, False]), ([one(0, cog=0.0, sog=2.0), one(10, cog=100.0, sog=2.0)], [False, False]),
     ([one(0, 0.0, cls="B", mode="CARRIER_SENSE"), one(10, 90.0, cls="B", mode="CARRIER_SENSE")], [False, False])],
)
def test_course(spark, rows, want):
    df = intervals.with_course(intervals.paired(reports(spark, rows)))
    assert [r.turning for r in df.orderBy("seq").collect()] == want


def test_exclusions(spark):
    rows = [one(0), one(10.5), one(1810.5), one(1820, lat=35.08), one(1830, lat=35.08)]
    got = intervals.analyzed(reports(spark, rows)).orderBy("seq").collect()
    assert [r.reason for r in got] == ["FIRST_REPORT", None, "GAP_30_MINUTES_OR_MORE", "DISTANCE_JUMP_OVER_30_KM", None]


def test_envelope_fragments_and_dedup(spark):
    body = "AIVDM,1,1,,A,13aG?P0000,0"
    mark = f"{__import__('functools').reduce(lambda a, c: a ^ ord(c), body, 0):02X}"
    df = spark.createDataFrame([(f"!{body}*{mark}",), (f"!{body}*00",), (f"!{body}",), ("!AIVDM,1,2,,A,x,0*00",), ("hello",)], "sentence string")
    assert [r.code for r in nmea.with_envelope(df).collect()] == [None, "CHECKSUM_INVALID", "CHECKSUM_MISSING", "INVALID_FRAGMENT", "INVALID_NMEA_FORMAT"]
    schema = "received_ns bigint, sequence bigint, source_id string, tag string, total int, number int, sequence_id string, channel string, payload string, fill_bits int"

    def run(*parts):
        rows = [(int(t * NS), k, "s", "!AIVDM", 2, n, q, "A", p, f) for k, (t, n, q, p, f) in enumerate(parts)]
        return sorted((r.payload, r.fill_bits, r.code) for r in ingest.assembled(spark.createDataFrame(rows, schema)).collect())

    assert run((0, 1, "7", "ABC", 0), (0.05, 1, "7", "ABC", 0), (0.1, 2, "7", "DEF", 2)) == [("ABCDEF", 2, None)]
    assert run((0, 2, "7", "DEF", 1), (0.1, 1, "7", "ABC", 0)) == [("ABCDEF", 1, None)]
    assert [r[2] for r in run((0, 1, "8", "ABC", 0), (40, 2, "8", "DEF", 0))] == ["INCOMPLETE_FRAGMENT"] * 2
    d = spark.createDataFrame([(0, 0), (999_000_000, 1), (2 * NS, 2), (int(2.9 * NS), 3), (int(3.8 * NS), 4)], "received_ns bigint, sequence bigint").withColumn("k", F.lit(1))
    assert [r.sequence for r in ingest.deduplicated(d, ("k",)).orderBy("sequence").collect()] == [0, 2]


def test_versions(spark):
    schema = "mmsi int, ts_ns bigint, seq bigint, vessel_class string, ship_length_m int"
    rows = [(1, 10, 0, "A", 49), (1, 20, 1, "UNKNOWN", None), (1, 30, 2, "A", 50), (1, 30, 3, "A", 51)]
    got = metadata.versions(metadata.merged(spark.createDataFrame(rows, schema))).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.ship_length_m) for r in got] == [(10, 30, 49), (30, None, 51)]


def test_quality_states(spark):
    day = [datetime.date(2026, 9, 1) + datetime.timedelta(k) for k in range(5)]
    facts = spark.createDataFrame([(d, b) for d, n in zip(day, (288, 276, 0, 275, 288), strict=True) for b in range(n)], "day date, bucket bigint")
    codes = spark.createDataFrame([(d, "ACCEPTED", 5) for d in day if d != day[2]] + [(day[4], "SOURCE_READ_FAILED", 1)], "day date, code string, n bigint")
    got = shiplength.daily_quality(facts, codes, spark.createDataFrame([(day[0], 1)], "day date, mmsi int"), str(day[0]), str(day[4])).orderBy("day").collect()
    assert [r.state for r in got] == ["ALL_BUCKETS_PRESENT", "PARTIAL", "NOT_ANALYZED", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]


def test_calibration(spark):
    days = [datetime.date(2026, 9, 1) + datetime.timedelta(k) for k in range(5)]
    rows = [(d, b, "A", m, o, x) for d in days for b, o, x in ((0, 80, 20), (2, 60, 40)) for m, o, x in ((1, o - 2, x - 2), (2, 1, 1), (3, 1, 1))]
    data = spark.createDataFrame(rows, "day date, band int, vessel_class string, mmsi int, observed bigint, missing bigint")
    got = {(r.band, r.vessel_class): r for r in calibrate.parameters(calibrate.pooled(data), calibrate.intervals_by_bootstrap(data, 200)).collect()}
    assert len(got) == 28 and got[0, "A"].kind == "DIRECT" and got[0, "A"].p == pytest.approx(400.5 / 501)
    assert (got[1, "A"].kind, got[1, "A"].from_band, got[1, "A"].to_band) == ("INTERPOLATED", 0, 2)
    assert got[3, "A"].kind == got[0, "B"].kind == "OUT_OF_MODEL"
    lo, hi = calibrate.day_bootstrap([(90, 100), (70, 100), (80, 100), (60, 100), (75, 100)], 1000, 42)
    assert lo < hi and (lo, hi) == calibrate.day_bootstrap([(90, 100), (70, 100), (80, 100), (60, 100), (75, 100)], 1000, 42)


@pytest.mark.parametrize("bound", [1, 2, 3, 30, 64, 1_500_000_001])
def test_draws_equal_the_java_library(spark, bound):
    other = spark._jvm.java.util.SplittableRandom(20251101)
    assert [other.nextInt(bound) for _ in range(300)] == calibrate.splittable_below(20251101, bound, 300).tolist()


def test_stream_equals_batch(spark, tmp_path):
    from tidewatch.operators.reports import reports_of_events

    batch = reports_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("mmsi % 3 = 0")
    half = batch.approxQuantile("ts_ns", [0.5], 0.0)[0]
    for k, part in enumerate((batch.where(F.col("ts_ns") <= half), batch.where(F.col("ts_ns") > half))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = live.write_intervals(live.live_intervals(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    columns = ["seq", "reason", "turning", "expected_s", "actual_s", "missing", "stale_s"]

    def shown(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())

    got = shown(spark.read.parquet(f"{tmp_path}/out"))
    assert len(got) == batch.count() and got == shown(intervals.analyzed(batch))


def test_log_files(spark, tmp_path):
    import gzip

    lines = "junk\n20240102000000000 !AIVDM,x\n20240102000001000 !AIVDM,y\n"
    (tmp_path / "a.ais").write_text(lines)
    (tmp_path / "a.ais.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "b.ais").write_text("nothing\n")
    files = logs.catalog(logs.read_lines(spark, str(tmp_path)))
    got = {r.file.rpartition("/")[2]: r for r in files.collect()}
    assert str(got["a.ais"].day) == "2024-01-02" and got["b.ais"].day is None and got["a.ais"].digest == got["a.ais.gz"].digest
    assert {r.file.rpartition("/")[2] for r in logs.without_counterparts(files).collect()} == {"a.ais", "b.ais"}
    assert {r.file.rpartition("/")[2] for r in logs.without_counterparts(files, False).collect()} == {"a.ais.gz", "b.ais"}
    assert logs.fingerprint(files).first().n_files == 3
    assert logs.coverage(files.where("day is not null"), "2024-01-01", "2024-01-03").where("missing").count() == 2


def test_decoded_table(spark):
    line = "07/06/01,00:00:00,1,0,477035000,0,-0.0,15.3,0,135.281295,34.702950,259.8,262,0,0,0,2,0:4:1"
    r = tables.decoded_rows(spark.createDataFrame([(line,), ("x,y",)], "value string")).where("valid").first()
    assert (r.sog, r.lon, r.lat, r.cog, r.heading, r.mmsi) == (15.3, 135.281295, 34.70295, 259.8, 262.0, 477035000)


def test_outlines(spark, tmp_path):
    (tmp_path / "c.senc").write_text("LAND 1\n135.1 34.1\n135.2 34.2\nBUOY\n1 2\n3 4\nRIVER\n5 6\n")
    got = tables.read_outlines(spark, str(tmp_path)).collect()
    assert [(r.kind, len(r.points), r.max_y) for r in got] == [("LAND", 2, 34.2)]


def test_store(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path))
    day = datetime.date(2026, 9, 1)
    for run, at in (("r1", 1), ("r2", 2)):
        s.publish((run, day, f"f{run}", "rx", "p", at), {"facts": spark.range(at)})
    s.write("facts", "r3", spark.range(9))
    assert s.read("facts").count() == 2 and s.equivalent("fr2", "rx", "p").count() == 1 and s.equivalent("fr1", "rx", "p").count() == 0
    store.write_report(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"), f"{tmp_path}/csv")
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True).fillna("").collect()) == [("1", "0.500000"), ("2", "")]


def test_as_of_gives_every_report_its_version(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(k, start + datetime.timedelta(seconds=37 * k), k % 40, "view", "{}") for k in range(400)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    history = metadata.versions(metadata.merged(queries._updates(spark, str(tmp_path)))).collect()
    want = {}
    for r in queries.reports(spark, str(tmp_path)).collect():
        valid = [h for h in history if h.mmsi == r.mmsi and h.valid_from <= r.ts_ns and (h.valid_to is None or r.ts_ns < h.valid_to)]
        want[r.event_id] = (r.mmsi, *((valid[0].ship_length_m, valid[0].vessel_name) if valid else (None, None)))
    got = queries.metadata_as_of(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 400 and {r.event_id: (r.mmsi, r.ship_length_m, r.vessel_name) for r in got} == want
    assert len(set(want.values())) > 20


def test_as_of_edges(spark):
    history = spark.createDataFrame([(1, 10, 20, 5), (1, 30, None, 7), (None, 0, None, 9)], "mmsi int, valid_from bigint, valid_to bigint, ship_length_m int")
    at = spark.createDataFrame([(1, 9), (1, 10), (1, 10), (1, 19), (1, 20), (1, 30), (2, 30), (None, 30), (1, None)], "mmsi int, at_ns bigint")
    got = sorted((tuple(r) for r in metadata.effective(history, at).select("mmsi", "at_ns", "ship_length_m").collect()), key=str)
    assert got == sorted([(1, 9, None), (1, 10, 5), (1, 10, 5), (1, 19, 5), (1, 20, None), (1, 30, 7), (2, 30, None), (None, 30, None), (1, None, None)], key=str)


def test_simulated_counts_come_from_the_engine(spark):
    start = 1_704_067_200 * NS
    at = [0.01] * 5 + [0.16] * 2 + [0.01] * 5
    rows = [(1, "A", start + (d * 86_400 + 10 * k) * NS, k, geo.RECEIVER_LAT + y, geo.RECEIVER_LON, 5.0, 10.0, None, 0, None, 1) for d in (0, 1) for k, y in enumerate(at)]
    data = spark.createDataFrame(rows, "mmsi int, vessel_class string, ts_ns bigint, seq bigint, lat double, lon double, sog double, cog double, heading double, nav_status int, class_b_mode string, message_type int")
    model = spark.createDataFrame([(0, "A", 1.0)], "band int, vessel_class string, p double")
    got = calibrate.simulated_counts(calibrate.replayed(data), model, spark.createDataFrame([("A", 1.0)], "vessel_class string, p double"), 2).collect()
    counts = {(r.seed, r.variant, r.band): (r.expected, r.lost) for r in got}
    want = {("CM_E1", 0): (16, 0), ("CLASS_ONLY", 0): (18, 0), ("CLASS_ONLY", 3): (4, 0)}
    assert counts == {(s, *k): n for s in (1, 2) for k, n in want.items()}


def test_replayed_lines_keep_their_millisecond(spark, tmp_path):
    """A report on a whole millisecond isn't written one early, which would put it before a report of the millisecond before."""
    base, at = 1_704_067_200_000_000, 1_704_067_200_002_000
    rows = [(3, base + 5 * (at - base)), (6, base + 5 * (at - base - 500)), (9, base + 5 * (at - base + 4000))]
    assert int(float(at * 1000) / 1000) == at - 1  # what dividing doubles makes of it
    spark.createDataFrame(rows, "event_id bigint, us bigint").select("event_id", F.lit(1).cast("bigint").alias("user_id"), F.timestamp_micros("us").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    (got,) = queries.log_replay_days(spark, str(tmp_path)).collect()
    assert (got.n, got.first_ns, got.last_ns, got.order_digest) == (3, (at - 1000) * 1000, (at + 4000) * 1000, 6 * 1 + 3 * 2 + 9 * 3)


def test_lines_are_gone_through_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame([("f", k, f"2024010100000{k}000 !AIVDM,2,{k},1,A,5,0*zz") for k in (1, 2)], "file string, line_no bigint, value string")
    assert {r.code for r in ingest.outcomes(lines.mapInArrow(counted, lines.schema)).collect()} == {"CHECKSUM_MALFORMED"}
    assert read.value == 2


def test_fields_laid_out_are_those_of_the_bit_string(spark):
    rows = spark.createDataFrame([(1, -1, "AZ _"), (123456789, -108_000_000, "zé[?\U0001f6a2x"), ((1 << 30) - 1, 91, None), (7, 0, "LONGER THAN TWENTY LETTERS")], "a bigint, b bigint, c string")
    bits = F.concat(nmea.to_bits(F.col("a"), 30), F.lit("0" * 7), nmea.to_bits(F.col("b"), 28), nmea.text_bits(F.col("c"), 42), nmea.text_bits(F.col("c"), 120), nmea.to_bits(F.col("a"), 60), F.lit("1"))
    made = nmea.laid_out((F.col("a"), 30), (0, 7), (F.col("b"), 28), *nmea.text_numbers(F.col("c"), 42), *nmea.text_numbers(F.col("c"), 120), (F.col("a"), 60), (1, 1))
    assert all(r.x == r.y for r in rows.select(nmea.armoured(bits).alias("x"), made.alias("y")).collect())

    def spelt(text):
        shown = [nmea.ALPHABET.find(c) if c in nmea.ALPHABET else 32 for c in (text or "")[:20].ljust(20, "@")]
        return "".join(f"{v:06b}" for v in shown)

    assert all(r.bits == spelt(r.c) for r in rows.select("c", nmea.text_bits(F.col("c"), 120).alias("bits")).collect())


def test_simulation_is_dealt_over_tasks_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "TASK_ROWS", 10)
    data = spark.range(40).selectExpr("CAST(431000000 + id % 20 AS INT) AS mmsi", "'A' AS vessel_class", f"{1_704_067_200 * NS} + id * 10 * {NS} AS ts_ns", "id AS seq", "34.5D AS lat", "135.0D AS lon", "5.0D AS sog", "10.0D AS cog", "10.0D AS heading", "0 AS nav_status", "CAST(NULL AS STRING) AS class_b_mode")
    sent = calibrate.replayed(data)
    n = sent.count()
    assert sent.rdd.getNumPartitions() == calibrate.tasks_for(n) > 4
    model = spark.range(9).selectExpr("CAST(id AS INT) AS band", "'A' AS vessel_class", "1.0D AS p")
    got = calibrate.simulated_counts(sent, model, spark.createDataFrame([("A", 1.0)], "vessel_class string, p double"), 2)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and {r.expected for r in got.collect()} == {n - 20}
