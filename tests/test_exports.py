import datetime
import json

from pyspark.sql import functions as F

from tidewatch.operators import legacy
from tidewatch.sources import exports, logs

DAY = datetime.date(2026, 9, 1)


def test_model_file(spark):
    parameters = spark.createDataFrame([(1, "B", "OUT_OF_MODEL", None, None, None), (0, "A", "DIRECT", 0.8, None, None), (1, "A", "INTERPOLATED", 0.7, 0, 2)], "band int, vessel_class string, kind string, p double, from_band int, to_band int")
    estimates = spark.createDataFrame([(0, "A", 80, 20, 3, 5, 100, 0.2, 0.8, 0.797)], "band int, vessel_class string, observed bigint, missing bigint, vessels bigint, days bigint, expected bigint, raw_loss double, raw_reception double, p double")
    bounds = spark.createDataFrame([(0, "A", 0.75, 0.85)], "band int, vessel_class string, ci_low double, ci_high double")
    got = [r.value for r in exports.model_file(parameters, estimates, bounds, {"formula": "1"}).collect()]
    assert got == ["﻿# formula: 1", exports.MODEL_HEADER, "0,0-5 km,CLASS_A,80,20,100,3,5,0.2,0.8,0.797,0.75,0.85,DIRECT,0.8,,", "1,5-10 km,CLASS_A,0,0,0,0,0,,,,,,INTERPOLATED,0.7,0,2", "1,5-10 km,CLASS_B,0,0,0,0,0,,,,,,OUT_OF_MODEL,,,"]


def test_validation_file(spark):
    names = "metric string, band int, vessel_class string, observed_pct double, day_low double, day_high double, mean double, median double, least double, most double, low double, high double, baseline_mean double, expected bigint, observed bigint, missing bigint, observed_s double, stale_s double, vessels bigint, days bigint, status string"
    row = ("LOSS", 0, "A", 10.0, 8.0, 12.0, 11.5, 11.0, 9.0, 13.0, 9.5, 12.5, None, 100, 90, 10, 50.5, 5.0, 3, 5, "MATCH")
    got = [r.value for r in exports.validation_file(spark.createDataFrame([row], names), {}).collect()]
    assert got[-1] == "LOSS,0,0-5 km,CLASS_A,10.000000,8.000000,12.000000,11.500000,11.000000,9.000000,13.000000,9.500000,12.500000,,1.500000,,100,90,10,50.5,5.0,3,5,MATCH"


def test_older_files(spark, tmp_path):
    rows = [(7, 1, 3.0, 1, DAY), (7, 1, 4.0, 0, DAY), (7, 1, 12.0, 0, DAY + datetime.timedelta(1)), (8, 5, 3.0, 0, DAY)]
    intervals = spark.createDataFrame(rows, "mmsi int, category int, start_km double, loss bigint, start_day date")
    lengths = spark.createDataFrame([(7, 120)], "mmsi int, ship_length_m int")
    exports.write_csv(exports.bins_file(intervals, lengths, 1), f"{tmp_path}/bins")
    got = spark.read.csv(f"{tmp_path}/bins", header=True)
    assert ",".join(got.columns) == exports.BINS_HEADER
    assert sorted(tuple(r) for r in got.collect()) == [("7", "0-10km", "120", "2", "3", "1", "33.333333333333336", "3.5"), ("7", "10-20km", "120", "1", "1", "0", "0.0", "12.0")]
    daily = exports.daily_file(intervals, lengths, 1).orderBy("DATE").collect()
    assert [(str(r.DATE), r.DAY_OF_WEEK, r.OBSERVED) for r in daily] == [("2026-09-01", "TUESDAY", 2), ("2026-09-02", "WEDNESDAY", 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/240101-1.ais").write_text("junk\njunk\n20240102000000000 !AIVDM,1,1,,A,13aG?P0000,0*00\n")
    lines = logs.read_lines(spark, f"{tmp_path}/in")
    _, counts = logs.drop_repeats_counted(lines)
    assert tuple(exports.input_file(counts, logs.catalog(lines)).first()) == ("240101-1.ais", 58, 3, 1, 1, 1)


def test_study_summary(spark):
    got = exports.study_summary({"a": spark.createDataFrame([(2, "x"), (1, "y\"")], "k int, v string"), "b": spark.range(0)}).first().value
    assert json.loads(got) == {"a": [{"k": 1, "v": 'y"'}, {"k": 2, "v": "x"}], "b": []}


def test_weekday_bins_and_totals(spark):
    rows = [(DAY, 0, m, 9, 1) for m in (1, 2, 3)] + [(DAY, 1, 1, 4, 0), (DAY + datetime.timedelta(1), 0, 1, 5, 5)]
    df = spark.createDataFrame(rows, "day date, bin int, mmsi int, observed bigint, loss bigint")
    got = {r.bin: r for r in legacy.bin_metrics(df, "TUESDAY").collect()}
    assert len(got) == 8 and (got[0].loss_pct, got[0].loss_per_vessel_day, got[0].small_sample) == (10.0, 1.0, False)
    assert (got[1].observed, got[1].loss_pct, got[1].small_sample) == (4, None, True) and got[5].observed == 0
    total = legacy.overall_metrics(df).first()
    assert (total.days, total.vessels, total.observed, total.loss, total.loss_per_vessel_day) == (2, 3, 36, 8, 8 / 6)
    assert tuple(legacy.overall_metrics(df, "SUNDAY").first())[:4] == (0, 0, 0, 0)
    assert {(r.period, r.bin): r.observed for r in legacy.by_period(df.withColumn("category", F.lit(1)), "YEAR", "bin").collect()} == {("2026", 0): 32, ("2026", 1): 4}
