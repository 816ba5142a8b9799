import datetime
import gzip

from pyspark.sql import functions as F

from tidewatch.functions import nmea
from tidewatch.operators import ingest, legacy, stored
from tidewatch.sources import logs, store, tables

DAY = datetime.date(2026, 9, 1)


def test_runs_by_day(spark, tmp_path):
    kept = store.ResultStore(spark, f"file://{tmp_path}/s")
    schema = store.STORED_RUN
    old = spark.createDataFrame([(f"a{k}", DAY + datetime.timedelta(k), "f", "rx", "p", k, None) for k in range(3)], schema)
    new = spark.createDataFrame([("b1", DAY + datetime.timedelta(1), "f", "rx", "p", 9, 11)], schema)
    facts = "run_id string, bucket bigint, band int, vessel_class string, observed bigint, missing bigint, observed_s double, stale_s double"
    presence = "run_id string, hour_ns bigint, band int, vessel_class string, mmsi int"
    noon = 1_788_231_600_000_000_000
    kept.publish_days(old, {"facts": spark.createDataFrame([(f"a{k}", noon + k * 86_400_000_000_000, 0, "A", 10, 1, 5.0, 0.0) for k in range(3)], facts), "presence": spark.createDataFrame([(f"a{k}", noon + k * 86_400_000_000_000, 0, "A", 7) for k in range(3)], presence)})
    for _ in range(2):  # a repeated write doesn't count twice
        kept.publish_days(new, {"facts": spark.createDataFrame([("b1", noon + 86_400_000_000_000, 0, "A", 20, 2, 5.0, 0.0)], facts), "presence": spark.createDataFrame([("b1", noon + 86_400_000_000_000, 0, "A", 8)], presence)})
    assert {r.run_id for r in kept.runs().collect()} == {"a0", "b1", "a2"} and kept.every_run().count() == 4
    states = {str(r.day): r.state for r in stored.day_states(kept.runs(), "2026-08-31", "2026-09-03", ("2026-09-03",)).collect()}
    assert states == {"2026-08-31": "MISSING", "2026-09-01": "INCLUDED", "2026-09-02": "INCLUDED", "2026-09-03": "EXCLUDED"}
    runs = stored.included(kept.runs(), "2026-09-01", "2026-09-03", ("2026-09-03",))
    got = stored.rollup(kept.read("facts"), kept.read("presence"), runs, "MONTH").first()
    assert (got.observed, got.missing, got.vessels, got.days) == (30, 3, 2, 2)
    assert stored.rollup(kept.read("facts"), kept.read("presence"), runs, "MONTH", vessel_class="B").count() == 0
    assert {r.run_id for r in stored.overlapping(kept.every_run(), 2, 10).collect()} == {"a2", "b1"}


def test_receivers_and_models(spark):
    d = lambda k: DAY + datetime.timedelta(k)
    rows = [("rx", "p1", d(0), d(9)), ("rx", "p2", d(10), None), ("ry", "p1", d(0), None), ("ry", "p2", d(5), d(6))]
    profiles = spark.createDataFrame(rows, "receiver string, profile string, valid_from date, valid_to date")
    assert {(r.receiver, r.profile) for r in stored.profile_on(profiles, str(d(6))).collect()} == {("rx", "p1"), ("ry", "p2")}
    assert [(r.receiver, r.profile) for r in stored.profile_overlaps(profiles).collect()] == [("ry", "p2")]
    changed = stored.upserted(profiles, spark.createDataFrame([("rx", "p2", d(12), None)], profiles.schema))
    assert changed.count() == 4 and changed.where("profile = 'p2' and receiver = 'rx'").first().valid_from == d(12)
    models = spark.createDataFrame([("rx", 3), ("ry", 8)], "receiver string, revision int")
    assert [stored.next_revision(models, x).first().revision for x in ("rx", "rz")] == [4, 1]
    runs, model = spark.createDataFrame([("r",)], "run_id string"), spark.createDataFrame([("DIRECT",)], "kind string")
    assert stored.trainable(runs, model, profiles, "rx", str(d(0)), str(d(20))).first().problems == []
    assert stored.trainable(runs.where("false"), model.where("false"), profiles, "rx", "2020-01-01", str(d(20))).first().problems == ["RECEIVER_NOT_VALID_AT_START", "NO_SOURCE_RUN", "NO_DIRECT_CELL"]


def test_digest_sees_the_order_of_lines(spark, tmp_path):
    lines = [f"2024010200000{k}000 !AIVDM,{k}" for k in range(8)]
    (tmp_path / "a.ais").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.ais").write_text("\n".join([lines[1], lines[0], *lines[2:]]) + "\n")
    (tmp_path / "a.ais.gz").write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    whole = {r.file.rpartition("/")[2]: r.digest for r in logs.catalog(logs.read_lines(spark, str(tmp_path))).collect()}
    assert whole["a.ais"] == whole["a.ais.gz"] != whole["b.ais"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        cut = {r.file.rpartition("/")[2]: r.digest for r in logs.catalog(logs.read_lines(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cut == whole


def test_replay(spark):
    rows = [("b", 2, "20240102000000000 !x"), ("b", 1, "20240102000000000 !x"), ("a", 10, "20240102000000000 !x"), ("a", 9, "20240102000000000 !x"), ("a", 1, "20240102000100000 !x"), ("a", 2, "20240103000000000 !x")]
    parsed = ingest.parsed_lines(spark.createDataFrame(rows, "file string, line_no bigint, value string"))
    day, span = ingest.replay_load(parsed, "2024-01-02")
    assert [(r.file, r.line_no) for r in day.orderBy("ordinal").collect()] == [("a", 9), ("a", 10), ("b", 1), ("b", 2), ("a", 1)]
    s = span.first()
    assert (s.n, s.outside_selected_day, s.last_ns - s.first_ns) == (5, 1, 60_000_000_000)
    assert sorted(r.ordinal for r in ingest.replay_order(parsed).collect()) == [1, 1, 2, 3, 4, 5]


def test_outcomes_of_bad_lines(spark):
    body = "AIVDM,2,1,4,A,55NBjP01mtGIL@CW;SM<D60P5Ld000000000000P0`<3557l0<50@kk@K5h@,0"
    mark = f"{__import__('functools').reduce(lambda a, c: a ^ ord(c), body, 0):02X}"
    rows = [("f", 1, "junk"), ("f", 2, f"20240102000000000 !{body}*{mark}"), ("f", 3, f"20240102000000000 !{body}*00"), ("f", 4, None)]
    got = ingest.outcomes(spark.createDataFrame(rows, "file string, line_no bigint, value string"))
    assert {r.code: r.n for r in ingest.diagnostics(got).collect()} == {"INVALID_LOG_LINE": 2, "INCOMPLETE_FRAGMENT": 1, "CHECKSUM_INVALID": 1}
    assert got.where("code is null").count() == 0


def test_text_fields_at_every_offset(spark):
    word = "AB 12-Z?"
    df = spark.range(1).select(*[nmea.armoured(F.concat(F.lit("1" * k), nmea.text_bits(F.lit(word), 60))).alias(f"p{k}") for k in range(40, 62)])
    read = df.select(*[nmea.text(nmea.words(nmea.packed(F.col(f"p{k}"))), k, 60).alias(f"t{k}") for k in range(40, 62)]).first()
    assert set(read) == {word}
    number = spark.range(1).select(*[nmea.unsigned(nmea.words(nmea.packed(nmea.armoured(F.concat(F.lit("0" * k), F.lit("1" + "0" * 28 + "1"))))), k, 30).alias(f"n{k}") for k in range(0, 70, 7)]).first()
    assert set(number) == {(1 << 29) + 1}
    assert spark.range(1).select(nmea.packed(F.lit("bad payload"))).first()[0] is None


def test_older_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h07060113.csv").write_text("07/06/01,13:05:00,1,0,431000001,0,-0.0,102.3,0,181.0,34.7,360.0,511,0,0,0,2\nx,y,z\n")
    rows = tables.hourly_rows(spark, f"{tmp_path}/in")
    assert {(r.hour, r.hour_from_name) for r in rows.collect()} == {(datetime.datetime(2007, 6, 1, 13), False), (datetime.datetime(2007, 6, 1, 13), True)}
    event = tables.adapted(rows.where("valid")).first()
    assert (event.received_ns, event.sog, event.cog, event.heading, event.lat, event.lon) == (1_180_670_700_000_000_000, None, None, None, None, None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r.csv").write_text("date,mmsi,type,bin,observed,loss\n2024-01-02,1,1,10-20km,5,1\n2024-01-02,1,1,80-90km,5,1\n2024-01-02,1,1,none,5,1\n2024-01-02,1,18,0-10km,x,1\n")
    assert [(r.bin_km, r.observed, r.loss) for r in tables.daily_results(spark, f"{tmp_path}/d").collect()] == [(10, 5, 1)]
    df = spark.createDataFrame([("a,b", None, 0.5), ('say "x"', 2, None)], "name string, n int, v double")
    lines = [r.value for r in store.marked_report(df, {"receiver": "rx"}, 3, ("n",)).collect()]
    assert lines == ["\ufeff# receiver: rx", "name,n,v", '"a,b",,0.500', '"say ""x""",2,']
    days = spark.createDataFrame([(datetime.date(2024, 7, 3), 1), (datetime.date(2024, 7, 4), 2)], "day date, k int")
    assert [r.k for r in legacy.matched_period(days, "07-03").collect()] == [1]


def test_digest_sees_line_ends_and_blocks(spark, tmp_path):
    lines = [f"2024010200{k // 60:02d}{k % 60:02d}000 !AIVDM,{k}" for k in range(3000)]
    put = lambda name, text: (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    whole = "\n".join(lines) + "\n"
    put("a.ais", whole)
    put("a.ais.gz", whole)
    put("crlf.ais", whole.replace("\n", "\r\n"))
    put("swap.ais", "\n".join([*lines[:1023], lines[1024], lines[1023], *lines[1025:]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.file.rpartition("/")[2]: r for r in logs.catalog(logs.read_lines(spark, str(tmp_path), exact_ends=True)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["a.ais"].digest == got["a.ais.gz"].digest and len({r.digest for r in got.values()}) == 3
    assert {r.n_lines for r in got.values()} == {3000} and got["a.ais"].n_chars == len(whole) and got["crlf.ais"].n_chars == len(whole) + 3000
    assert {str(r.day) for r in got.values()} == {"2024-01-02"}


def test_repeated_lines_are_counted(spark):
    stamp = "20240102000000000 "
    rows = [("f", 0, stamp + "!AIVDM,1,1,,A,13aG?P0000,0*00"), ("f", 1, stamp + "!AIVDM,1,1,,A,13aG?P0000,0*00"), ("f", 2, "junk"), ("f", 3, "junk"), ("f", 4, stamp + "!AIVDM,1,1,,A,4xx,0*00"), ("g", 0, stamp + "!AIVDM,1,1,,A,B3aG?P0000,0*00")]
    kept, counts = logs.drop_repeats_counted(spark.createDataFrame(rows, "file string, line_no bigint, value string"))
    assert sorted((r.file, r.line_no) for r in kept.collect()) == [("f", 0), ("f", 2), ("f", 4), ("g", 0)]
    assert sorted(tuple(r) for r in counts.select("file", "total", "duplicate", "invalid", "target").collect()) == [("f", 5, 2, 1, 1), ("g", 1, 0, 0, 1)]


def test_archive_days(spark):
    names = ["240101-1.ais", "240101-2.ais", "240103-1.ais", "240103-1.ais.gz", "240105-1.AIS.GZ", "241399-1.ais", "notes.txt"]
    found = logs.archive(spark.createDataFrame([(f"file:///a/{n}", 10 + k) for k, n in enumerate(names)], "file string, n_bytes bigint"))
    days = {str(r.day): (r.n_files, r.n_bytes, r.parts, r.overlaps, r.multipart) for r in logs.archive_days(found).collect()}
    assert days == {"2024-01-01": (2, 21, 2, 0, True), "2024-01-03": (2, 25, 1, 1, False), "2024-01-05": (1, 14, 1, 0, False)}
    span = logs.archive_span(found).first()
    assert (span.days, span.calendar_days, span.missing_days, span.multipart_days, span.overlaps, span.n_bytes) == (3, 5, 2, 1, 1, 60)
    assert logs.archive_span(found.where("false")).first().missing_days == 0


def test_stored_rows_of_a_time_and_class(spark, tmp_path):
    kept = store.ResultStore(spark, f"{tmp_path}/s")
    kept.publish(("r", DAY, "f", "rx", "p", 1), {"facts": spark.createDataFrame([(k, c, 0.5) for k in range(4) for c in "AB"], "bucket bigint, vessel_class string, v double")})
    assert sorted((r.bucket, r.vessel_class) for r in kept.read("facts", 1, 3, ("A",)).collect()) == [(1, "A"), (2, "A")]
    report = store.marked_report(spark.createDataFrame([(0.5, 2.0)], "rate double, seconds double"), {}, {"seconds": 3})
    assert [r.value for r in report.collect()][-1] == "0.500000,2.000"


def test_answers_are_in_order(spark):
    rolled = spark.createDataFrame([("SUNDAY", 1, "A"), ("MONDAY", 1, "B"), ("MONDAY", 0, "A")], "period string, band int, vessel_class string")
    got = stored.answered(rolled, spark.range(3)).collect()
    assert [(r.period, r.band_label, r.included_runs) for r in got] == [("MONDAY", "0-5 km", 3), ("MONDAY", "5-10 km", 3), ("SUNDAY", "5-10 km", 3)]
