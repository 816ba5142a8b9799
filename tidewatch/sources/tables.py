"""Decoded position tables and chart outlines from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column numbers of the decoded table, fixed by its format: dynamic fields, then those of static reports.
DYNAMIC = {"nav_status": (5, "int"), "sog": (7, "double"), "lon": (9, "double"), "lat": (10, "double"), "cog": (11, "double"), "heading": (12, "double")}
STATIC = {"imo": (19, "int"), "call_sign": (20, "string"), "vessel_name": (21, "string"), "ship_type": (22, "int")}
DESTINATION_FROM = 31
OUTLINES = ("LAND", "COASTLINE", "RIVER")


def decoded_rows(lines: DataFrame) -> DataFrame:
    """Typed columns of ``lines(value)``; what doesn't parse is null, ``valid`` needs a time, a type and a nine-digit vessel."""
    df = lines.withColumn("f_", F.split("value", ",", -1))
    part = lambda k: F.trim(F.get("f_", F.lit(k)))
    at = F.try_to_timestamp(F.concat_ws(" ", part(0), part(1)), F.lit("yy/MM/dd HH:mm:ss"))
    kind = part(2).try_cast("int")
    df = df.withColumns({"local_us": F.unix_micros(at), "message_type": kind, "mmsi": F.when(part(4).rlike("^[0-9]{9}$") & (part(4) != "000000000"), part(4).try_cast("int"))})
    fields = {n: F.nullif(part(k), F.lit("")).try_cast(t) for n, (k, t) in DYNAMIC.items()} | {n: F.when(kind == 5, F.nullif(part(k), F.lit("")).try_cast(t)) for n, (k, t) in STATIC.items()}
    length = F.nullif(part(23).try_cast("int") + part(24).try_cast("int"), F.lit(0))
    rest = F.array_join(F.slice("f_", F.lit(DESTINATION_FROM + 1), F.greatest(F.size("f_") - DESTINATION_FROM, F.lit(0))), ",")
    df = df.withColumns(fields | {"ship_length_m": F.when(kind == 5, length), "destination": F.when(kind == 5, F.nullif(F.trim(rest), F.lit("")))})
    return df.withColumn("valid", F.col("local_us").isNotNull() & kind.isNotNull() & F.col("mmsi").isNotNull()).drop("f_")


def hourly_rows(spark: SparkSession, root: str) -> DataFrame:
    """Decoded rows of an archive of hourly files below ``root``: ``hour`` is that of the row's time, or of digits YYMMDDHH in the file's name."""
    raw = spark.read.option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("file"), "value")
    df = decoded_rows(raw)
    named = F.try_to_timestamp(F.nullif(F.regexp_extract("file", r"([0-9]{8})[^/0-9]*$", 1), F.lit("")), F.lit("yyMMddHH"))
    own = F.date_trunc("hour", F.timestamp_micros("local_us"))
    return df.withColumn("hour", F.coalesce(own, named)).withColumn("hour_from_name", own.isNull() & named.isNotNull())


def daily_results(spark: SparkSession, root: str, max_km: int = 80) -> DataFrame:
    """Rows of daily result files with a header (date, mmsi, type, bin, observed, loss): ``bin_km`` is the first number of ``bin``.

    Rows without a bin of [0, max_km) or without a count that parses are left out.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("header", True).csv(root)
    typed = {"day": F.col("date").try_cast("date"), "mmsi": F.col("mmsi").try_cast("int"), "category": F.col("type").try_cast("int"), "bin_km": F.regexp_extract("bin", r"^\s*([0-9]+)", 1).try_cast("int"), "observed": F.col("observed").try_cast("bigint"), "loss": F.col("loss").try_cast("bigint")}
    df = raw.select(*[c.alias(n) for n, c in typed.items()])
    return df.where(F.col("day").isNotNull() & F.col("bin_km").between(0, max_km - 1) & F.col("observed").isNotNull() & F.col("loss").isNotNull())


def adapted(rows: DataFrame) -> DataFrame:
    """Older decoded rows as events: local time becomes received_ns, values that stand for nothing become null."""
    place = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return rows.withColumns({
        "received_ns": (F.col("local_us") - 9 * 3600 * 1_000_000) * 1000, "sog": F.when((F.col("sog") >= 0) & (F.col("sog") < 102.3), F.col("sog")), "cog": F.when((F.col("cog") >= 0) & (F.col("cog") < 360), F.col("cog")),
        "heading": F.when((F.col("heading") >= 0) & (F.col("heading") < 360), F.col("heading")), "nav_status": F.when(F.col("nav_status").between(0, 15), F.col("nav_status")), "lat": F.when(place, F.col("lat")), "lon": F.when(place, F.col("lon")),
    })


def table_summary(rows: DataFrame) -> DataFrame:
    """Counts by type of valid rows, repeats and vessels."""
    known = rows.where("valid")
    once = known.groupBy("message_type", "value").agg(F.count("*").alias("n"), F.first("mmsi").alias("mmsi"))
    return once.groupBy("message_type").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.countDistinct("mmsi").alias("vessels"))


def read_outlines(spark: SparkSession, root: str, encoding: str = "UTF-8") -> DataFrame:
    """Chart features below ``root`` of at least two points: (file, feature, kind, points, bounds).

    A line whose first token isn't a number starts a feature. Chart files are small; each is ordered as a whole.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("encoding", encoding).text(root)
    df = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("k"), F.split(F.trim("value"), r"[\s,]+").alias("t")).where(F.col("t")[0] != "")
    x = F.get("t", F.lit(0)).try_cast("double")
    feature = F.sum(F.when(x.isNull(), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("feature", feature).withColumn("x", x).withColumn("y", F.get("t", F.lit(1)).try_cast("double"))
    point = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("k", "x", "y"))
    out = df.groupBy("file", "feature").agg(F.max(F.when(F.col("x").isNull(), F.upper(F.col("t")[0]))).alias("kind"), F.array_sort(F.collect_list(point)).alias("points"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"])
    return out.where(F.col("kind").isin(*OUTLINES) & (F.size("points") >= 2)).withColumn("points", F.transform("points", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))
