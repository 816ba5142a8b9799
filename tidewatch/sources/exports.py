"""Files for other tools: the reception model and its validation, the older statistics, and the summary of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import legacy
from tidewatch.sources.store import marked_report

#: Headers of the files, fixed values of their readers.
MODEL_HEADER = "距離帯index,距離帯,Class,受信数,推定欠落数,期待送信数,MMSI数,観測日数,生欠落率,生受信率,Jeffreys補正受信確率,CI下限,CI上限,適用状態,適用受信確率,近距離側補間元,遠距離側補間元"
VALIDATION_HEADER = "指標,距離帯index,距離帯,Class,実測値%,実測日別2.5%,実測日別97.5%,CM-E1平均%,CM-E1中央値%,CM-E1最小%,CM-E1最大%,CM-E1変動下限%,CM-E1変動上限%,距離なし基準平均%,実測との差pp,基準の実測との差pp,期待送信数,受信数,推定欠落数,観測秒,鮮度違反秒,MMSI数,観測日数,判定"
BINS_HEADER = "MMSI,DISTANCE_BIN,SHIP_LENGTH,OBSERVED,EXPECTED,LOSS,LOSS_RATE,AVG_DISTANCE"
DAILY_HEADER = "DATE,DAY_OF_WEEK,MESSAGE_TYPE,MMSI,DISTANCE_BIN,SHIP_LENGTH,OBSERVED,EXPECTED,LOSS,LOSS_RATE,AVG_DISTANCE"
INPUT_HEADER = "FILE_NAME,FILE_SIZE_BYTES,TOTAL_ROWS,EXACT_DUPLICATE_ROWS,TARGET_MESSAGES,INVALID_OR_NON_TARGET_ROWS"


def band_label(band: Column, width: int = int(geo.BAND_KM)) -> Column:
    return F.concat((band * width).cast("string"), F.lit("-"), ((band + 1) * width).cast("string"), F.lit(" km"))


def _table(columns: list[Column], header: str, df: DataFrame) -> DataFrame:
    names = header.split(",")
    return df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


def _class(c: str = "vessel_class") -> Column:
    return F.concat(F.lit("CLASS_"), F.col(c))


def model_file(parameters: DataFrame, estimates: DataFrame, bounds: DataFrame, about: dict[str, str]) -> DataFrame:
    """Lines of a model's file: each band and class with what it was estimated from, its bounds and what applies. Numbers in full length."""
    df = parameters.withColumnRenamed("p", "applied").join(estimates, ["band", "vessel_class"], "left").join(bounds, ["band", "vessel_class"], "left").fillna(0, ["observed", "missing", "expected", "vessels", "days"])
    full = lambda c: F.col(c).cast("string")
    columns = [F.col("band"), band_label(F.col("band")), _class(), *[F.col(c) for c in ("observed", "missing", "expected", "vessels", "days")], *[full(c) for c in ("raw_loss", "raw_reception", "p", "ci_low", "ci_high")], F.col("kind"), full("applied"), F.col("from_band"), F.col("to_band")]
    return marked_report(_table(columns, MODEL_HEADER, df), about, order=("距離帯index", "Class"))


def validation_file(cells: DataFrame, about: dict[str, str]) -> DataFrame:
    """Lines of a validation's file; ``cells`` have one row per metric, band and class under the names used here."""
    columns = [F.col("metric"), F.col("band"), band_label(F.col("band")), _class(), *[F.col(c).cast("double") for c in ("observed_pct", "day_low", "day_high", "mean", "median", "least", "most", "low", "high", "baseline_mean")], (F.col("mean") - F.col("observed_pct")).cast("double"), (F.col("baseline_mean") - F.col("observed_pct")).cast("double"), *[F.col(c) for c in ("expected", "observed", "missing")], *[F.col(c).cast("string") for c in ("observed_s", "stale_s")], F.col("vessels"), F.col("days"), F.col("status")]
    return marked_report(_table(columns, VALIDATION_HEADER, cells), about, order=("指標", "距離帯index", "Class"))


def _bin_label(width: int = legacy.BIN_KM) -> Column:
    return F.concat((F.col("bin") * width).cast("string"), F.lit("-"), ((F.col("bin") + 1) * width).cast("string"), F.lit("km"))


def bins_file(intervals: DataFrame, lengths: DataFrame, message_type: int) -> DataFrame:
    """A row for each vessel and ten-kilometre bin of a type, under the older headers; ``lengths(mmsi, ship_length_m)``."""
    df = legacy.distance_bins(intervals.where(F.col("category") == message_type)).join(lengths, "mmsi", "left")
    return _table([F.col("mmsi"), _bin_label(), F.col("ship_length_m"), F.col("observed"), F.col("expected"), F.col("loss"), F.col("loss_pct"), F.col("avg_km")], BINS_HEADER, df)


def daily_file(intervals: DataFrame, lengths: DataFrame, message_type: int) -> DataFrame:
    """The same by the local day on which an interval begins."""
    df = legacy.distance_bins(intervals.where(F.col("category") == message_type), ("start_day", "mmsi", "category")).join(lengths, "mmsi", "left")
    day = F.upper(F.date_format("start_day", "EEEE"))
    return _table([F.col("start_day"), day, F.col("category"), F.col("mmsi"), _bin_label(), F.col("ship_length_m"), F.col("observed"), F.col("expected"), F.col("loss"), F.col("loss_pct"), F.col("avg_km")], DAILY_HEADER, df)


def input_file(counts: DataFrame, files: DataFrame) -> DataFrame:
    """What a loader counted in each file, with its bytes; of ``drop_repeats_counted`` and ``catalog``."""
    df = counts.join(files.select("file", "n_chars"), "file")
    return _table([F.element_at(F.split("file", "/"), -1), F.col("n_chars"), F.col("total"), F.col("duplicate"), F.col("target"), F.col("total") - F.col("duplicate") - F.col("target")], INPUT_HEADER, df)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def study_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row ``value``: the tables of a study as one JSON object of lists. For summary tables, which are small."""
    spark = next(iter(tables.values())).sparkSession
    parts = spark.createDataFrame([], "name string, value string")
    for name, df in tables.items():
        parts = parts.union(df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows")).select(F.lit(name), F.to_json("rows")))
    pair = F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), F.col("value"))
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("value"))
