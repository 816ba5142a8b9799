import datetime

from pyspark.sql import functions as F

from tidewatch.functions import rates
from tidewatch.operators import cube, intervals
from tidewatch.operators.reports import reports_of_events
from tidewatch.streaming import live
from tidewatch.streaming.facts import LiveFacts, write_facts

NS = rates.NS


def shown(df):
    return sorted(tuple(round(v + 3e-7, 4) if isinstance(v, float) else v for v in r) for r in df.select("bucket", "band", "vessel_class", *cube.MEASURES, "vessels").collect())


def test_stream_facts_equal_batch_facts(spark, tmp_path):
    reports = reports_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("mmsi % 4 = 1")
    cuts = reports.approxQuantile("ts_ns", [0.3, 0.7], 0.0)
    put = lambda k, cond: reports.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    put(0, F.col("ts_ns") <= cuts[0])
    put(1, (F.col("ts_ns") > cuts[0]) & (F.col("ts_ns") <= cuts[1]))
    facts = LiveFacts(spark, f"{tmp_path}/facts")

    def run():
        stream = spark.readStream.schema(reports.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        query = write_facts(live.live_intervals(stream), facts, f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()

    def batch(cond):
        return cube.facts(cube.band_contributions(intervals.accepted(reports.where(cond))), ["band"])

    assert facts.state() is None and facts.facts().count() == 0
    run()
    assert facts.state() == "PENDING"
    facts.finish()
    assert facts.state() == "COMPLETE" and shown(facts.facts()) == shown(batch(F.col("ts_ns") <= cuts[1]))
    put(2, F.col("ts_ns") > cuts[1])
    run()  # from the checkpoint: what is there isn't added again
    assert facts.state() == "PENDING"
    facts.finish()
    assert shown(facts.facts()) == shown(batch(F.lit(True)))


OUT = live.OUT


def interval(mmsi, start_s, end_s, seq, missing=0):
    base = 1_704_067_200
    return (mmsi, "A", seq, (base + start_s) * NS, (base + end_s) * NS, 34.68, 135.2, 34.69, 135.21, 1.0, None, False, 10.0, float(end_s - start_s), missing, 0.0)


def test_late_intervals_reopen_a_bucket_and_repeated_batches_do_not_count_twice(spark, tmp_path):
    facts = LiveFacts(spark, f"{tmp_path}/facts")
    frame = lambda *rows: spark.createDataFrame(rows, OUT)
    total = lambda: {r.bucket // NS - 1_704_067_200: (r.observed, r.vessels) for r in facts.facts().groupBy("bucket").agg(F.sum("observed").alias("observed"), F.max("vessels").alias("vessels")).collect()}
    facts.add(frame(interval(1, 0, 10, 1)), 0)
    facts.add(frame(interval(1, 10, 20, 2)), 1)
    assert total() == {0: (1, 1)}  # the second waits for the next boundary
    for _ in range(2):
        facts.add(frame(interval(1, 300, 310, 3)), 2)
    assert total() == {0: (2, 1), 300: (1, 1)}
    facts.add(frame(interval(2, 30, 40, 4)), 3)  # late
    facts.add(frame(interval(1, 600, 610, 5)), 4)
    assert total() == {0: (3, 2), 300: (1, 1), 600: (1, 1)}
    facts.finish()
    facts.add(frame(), 5)
    assert facts.state() == "PENDING" and total()[0] == (3, 2)


REPORT = "mmsi int, vessel_class string, class_b_mode string, ts_ns bigint, sog double, cog double, heading double, nav_status int, lat double, lon double, seq bigint, session bigint"


def test_a_pause_and_a_clock_step_cut_intervals(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()
    rows = [(1, "A", None, int((at + t) * NS), 5.0, None, None, 0, 34.68, 135.2, k, s) for k, (t, s) in enumerate([(0, 0), (10, 0), (20, 1), (30, 1)])]
    step = [(1, "A", None, int((at + t) * NS), 5.0, None, None, 0, 34.68, 135.2, 10 + k, 1) for k, t in enumerate([5, 15])]
    for k, part in enumerate((rows, step)):
        spark.createDataFrame(part, REPORT).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(spark.createDataFrame([], REPORT).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.write_intervals(live.live_intervals(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    got = {r.seq: r.reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: "FIRST_REPORT", 1: None, 2: "LIVE_PAUSE_BOUNDARY", 3: None, 10: "NEGATIVE_INTERVAL", 11: None}
