import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import rates
from tidewatch.operators import cube, gaps, intervals, replay, stored
from tidewatch.operators.reports import reports_of_events

NS = rates.NS
START = 1_704_034_800  # midnight in Japan
REPORT = "mmsi int, vessel_class string, class_b_mode string, ts_ns bigint, sog double, cog double, heading double, nav_status int, lat double, lon double, seq bigint"


def reports(spark, rows):
    return spark.createDataFrame([(m, c, None, int((START + t) * NS), 5.0, None, 90.0 if c == "A" else None, 0, 34.68, 135.2, k) for k, (m, c, t) in enumerate(rows)], REPORT)


def shown(df):
    return {r.mmsi: (r.vessel_class, r.state, r.age_s, r.visible, [p.seq for p in r.trail]) for r in df.collect()}


def test_snapshot_shows_freshness_and_trail(spark):
    rows = intervals.analyzed(reports(spark, [(1, "A", 0), (1, "A", 40), (2, "B", 0), (2, "B", 3000)]))
    at = lambda t, **k: shown(replay.displayed(replay.latest(rows.where(F.col("ts_ns") <= (START + t) * NS)), replay.trails(rows, (START + t) * NS), (START + t) * NS, **k))
    assert at(71) == {1: ("A", "VIOLATION", 31.0, True, [0, 1]), 2: ("B", "CAUTION", 71.0, True, [2])}
    assert at(50)[1][1] == "NORMAL" and at(70)[1][1] == "CAUTION"
    assert set(at(71, classes=("A",))) == {1}
    assert at(640)[1][3] is False and at(639.5)[1][3] is True
    assert at(3700)[2] == ("B", "VIOLATION", 700.0, False, [3]) and at(3600)[2][4] == [2, 3]


def test_a_seek_equals_advancing_and_rebuilding(spark, tmp_path):
    day = reports_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    index = replay.ReplayIndex(spark, f"{tmp_path}/replay")
    index.build(day)
    rows = replay.by_day(day).cache()
    times = [START + 86_400 + s for s in (30, 5_000, 40_000, 40_001, 86_399)]
    states, before = index.states(times[0] * NS), times[0] * NS
    for t in (x * NS for x in times):
        own = rows.where((F.col("ts_ns") <= t) & (F.col("day") == cube.jst_day(F.lit(t))))
        whole = replay.latest(own)
        states, before = replay.advanced(states, own, before, t), t
        want = sorted(map(tuple, whole.collect()))
        assert sorted(map(tuple, states.collect())) == want == sorted(map(tuple, index.states(t).collect()))
        assert shown(index.seek(t)) == shown(replay.displayed(whole, replay.trails(own, t), t))
    assert index.states((START - 10) * NS).count() == 0
    with pytest.raises(ValueError):
        index.seek(times[0] * NS, trail_s=4000)


def test_a_seek_reads_two_hours(spark, tmp_path):
    index = replay.ReplayIndex(spark, f"{tmp_path}/replay")
    index.build(reports(spark, [(m, "A", 600 * k) for m in range(3) for k in range(144)]))
    at = (START + 36_000) * NS
    assert index.rows(at).count() == 3 * 7 and index.states(at).count() == 3
    plan = index.rows(at)._jdf.queryExecution().executedPlan().toString()
    hour = at // replay.HOUR_NS
    assert "PartitionFilters: [hour" in plan and f"IN ({hour - 1},{hour})" in plan


DAY = datetime.date(2026, 9, 1)


def test_dataset_days(spark):
    d = lambda k: DAY + datetime.timedelta(k)
    runs = spark.createDataFrame([("r0", d(0), "rx", "p"), ("r1", d(1), "rx", "p"), ("r1b", d(1), "rx", "p"), ("r2", d(2), "rx", "p"), ("r3", d(3), "ry", "p"), ("r4", d(4), "rx", "p")], "run_id string, day date, receiver string, profile string")
    args = (str(d(0)), str(d(5)), (str(d(2)),))
    days = stored.run_days(runs, *args, "rx", "p")
    assert {r.run_id for r in days.collect()} == {"r0", "r4"}
    states = {r.day: r.state for r in stored.day_states(runs.where("receiver = 'rx'"), *args).collect()}
    assert [states[d(k)] for k in range(6)] == ["INCLUDED", "AMBIGUOUS", "EXCLUDED", "MISSING", "INCLUDED", "MISSING"]
    with pytest.raises(Exception, match="several active runs on 2026-09-02"):
        stored.demand_one_run(runs, *args).collect()
    facts = spark.createDataFrame([("r0", 0, "A", 90, 10, 50.0, 5.0), ("r0", 0, "A", 0, 0, 0.0, 0.0), ("r4", 0, "A", 60, 40, 0.0, 0.0), ("r4", 1, "B", 0, 0, 9.0, 3.0), ("r1", 0, "A", 9, 9, 9.0, 9.0), ("r0", 2, "UNKNOWN", 5, 5, 5.0, 5.0)], "run_id string, band int, vessel_class string, observed bigint, missing bigint, observed_s double, stale_s double")
    presence = spark.createDataFrame([("r0", 0, "A", 7), ("r0", 0, "A", 7), ("r0", 0, "A", 8), ("r4", 0, "A", 7), ("r4", 9, "A", 7)], "run_id string, band int, vessel_class string, mmsi int")
    got = {(r.day, r.band): (r.observed, r.missing, r.vessels) for r in stored.calibration_rows(facts, presence, days).collect()}
    assert got == {(d(0), 0): (90, 10, [7, 8]), (d(4), 0): (60, 40, [7]), (d(4), 1): (0, 0, [])}
    cells = {(r.band, r.vessel_class): r for r in stored.observed_validation(facts, presence, days).collect()}
    a, b = cells[0, "A"], cells[1, "B"]
    assert (a.observed, a.missing, a.days, a.vessels, a.daily_loss_pct, a.daily_stale_pct) == (150, 50, 2, 2, [10.0, 40.0], [10.0])
    assert (b.days, b.vessels, b.daily_loss_pct, b.daily_stale_pct) == (1, 0, [], [pytest.approx(100 / 3)])


def test_rolled_facts_without_presence_have_no_vessels(spark):
    facts = spark.createDataFrame([("r", 0, 0, "A", 1, 0, 1.0, 0.0), ("r", 0, 1, "A", 1, 0, 1.0, 0.0)], "run_id string, bucket bigint, band int, vessel_class string, observed bigint, missing bigint, observed_s double, stale_s double")
    presence = spark.createDataFrame([("r", 0, 0, "A", 5)], "run_id string, hour_ns bigint, band int, vessel_class string, mmsi int")
    got = stored.rollup(facts, presence, spark.createDataFrame([("r",)], "run_id string"), "DAY")
    assert {r.band: r.vessels for r in got.collect()} == {0: 1, 1: 0}


def test_message_gaps(spark):
    rows = [(5, 0.0), (5, 360.4), (5, 360.4), (5, 300.0), (5, 4200.0), (18, 0.0), (18, 30.3), (18, 95.0)]
    df = spark.createDataFrame([(1, t, int((START + s) * 1000) * 1_000_000, k, 30.0, 20.0, "CARRIER_SENSE") for k, (t, s) in enumerate(rows)], "mmsi int, message_type int, ts_ns bigint, seq bigint, expected_here double, sog double, class_b_mode string")
    found = gaps.message_gaps(df)
    got = {r.category: r for r in gaps.gap_totals(found).collect()}
    five = got[5]
    assert (five.messages, five.intervals, five.negative, five.zero, five.below_half, five.track_gaps, five.valid, five.loss, five.ceil_loss) == (5, 4, 1, 1, 1, 1, 2, 0, 0)
    assert (got[18].valid, got[18].loss, got[18].changed) == (2, 1, 0)
    group = gaps.class_b_groups(found).first()
    assert (group.unit, group.speed, group.n, group.loss, group.p50, group.p90) == ("CS", ">14", 2, 1, 30, 65)
    assert [(r.category, r.expected_s, r.n) for r in gaps.expected_histogram(found).orderBy("category").collect()] == [(5, 360.0, 2), (18, 30.0, 2)]


def test_states_at_equal_those_of_all_that_came_before(spark):
    """Only the last reports of each vessel are analysed: turns, pauses, two classes under one number, equal times and gaps make no difference."""
    import random

    rng, rows, seq = random.Random(4), [], 0
    for mmsi in range(60):
        at, head = 0, rng.randrange(360)
        for _ in range(rng.choice([1, 3, 40, 120])):
            at += rng.choice([0, 2, 5, 10, 10, 19, 20, 21, 29, 30, 31, 60, 1799, 1800, 4000]) if rng.random() < 0.3 else rng.choice([2, 5, 10])
            head = (head + (rng.choice([0, 1, 6, 40]) if rng.random() < 0.4 else 0)) % 360
            seq += 1
            both = mmsi % 3 == 0 and rng.random() < 0.4
            rows.append((seq, mmsi, "B" if both else "A", "SELF_ORGANIZING", at * NS, 1, rng.choice([3.0, 12.0, 18.0]), float(head), rng.choice([None, float(head)]), 0, 34.0 + rng.random() / 100, 135.0 + (1.0 if rng.random() < 0.02 else 0.0), seq))
    df = spark.createDataFrame(rows, "event_id bigint, mmsi int, vessel_class string, class_b_mode string, ts_ns bigint, message_type int, sog double, cog double, heading double, nav_status int, lat double, lon double, seq bigint")
    whole = intervals.analyzed(df).select("mmsi", *replay.STATE).cache()
    turning = 0
    for at_ns in (60 * NS, 301 * NS, 777 * NS, 5000 * NS, 10**15):
        want = sorted(map(tuple, replay.latest(whole.where(F.col("ts_ns") <= at_ns)).collect()))
        assert sorted(map(tuple, replay.states_at(df, at_ns).collect())) == want
        turning += sum(round(r[-1], 6) in (2.0, 5.0, round(10 / 3, 6)) for r in want)
    assert turning > 20
    whole.unpersist()
