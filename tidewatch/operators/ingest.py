"""From raw lines to normalised events: line parsing, replay order, fragment assembly, de-duplication, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import nmea
from tidewatch.functions.steps import held
from tidewatch.operators import fragments
from tidewatch.sources.work import saved

NS = 1_000_000_000
REPEAT_NS, JST_US = NS, 9 * 3600 * 1_000_000


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``value`` to received_ns and sentence; ``code`` INVALID_LOG_LINE where it isn't <17 digits> <sentence>."""
    v = F.regexp_replace("value", "^﻿", "")
    # held, so that neither pattern nor time is gone through for each column that is made of them
    df = held(held(lines, "stamp_", F.regexp_extract(v, r"^(\S+)\s+(.*)$", 1)), "rest_", F.trim(F.regexp_extract(v, r"^(\S+)\s+(.*)$", 2)))
    stamp = F.col("stamp_")
    # Spark's parser needs a separator before the milliseconds
    df = held(df, "at_", F.unix_micros(F.try_to_timestamp(F.when(stamp.rlike("^[0-9]{17}$"), F.concat(F.left(stamp, F.lit(14)), F.lit("."), F.right(stamp, F.lit(3)))), F.lit("yyyyMMddHHmmss.SSS"))))
    at = F.col("at_")
    df = df.withColumn("received_ns", (at - JST_US) * 1000).withColumn("sentence", F.when(at.isNotNull(), F.col("rest_")))
    return df.withColumn("code", F.when(at.isNull() | (F.col("sentence") == ""), "INVALID_LOG_LINE")).drop("stamp_", "rest_", "at_")


def record_order(file: Column, line_no: Column, line_type: T.DataType) -> Column:
    """Text that sorts by (file, line number), whatever number or (split, row) ``line_no`` is."""
    digits = lambda c: F.lpad(c.cast("string"), 19, "0")
    if isinstance(line_type, T.StructType):
        return F.concat_ws(":", file, *[digits(line_no[f.name]) for f in line_type])
    return F.concat_ws(":", file, digits(line_no))


def with_record_order(records: DataFrame) -> DataFrame:
    """Add ``sequence``: merged files are in the order of (received_ns, sequence), and nothing needs to be shuffled for it."""
    return records.withColumn("sequence", record_order(F.col("file"), F.col("line_no"), records.schema["line_no"].dataType))


def jst_date_number(ns: Column) -> Column:
    return F.floor((ns / 1000 + JST_US) / 86_400_000_000).cast("int")


def replay_order(records: DataFrame) -> DataFrame:
    """Merge of all files by (time, file order, line number) within each day; ``ordinal`` counts from 1 in each ``day``.

    A minute is numbered in one task and shifted by what earlier minutes of its day hold: counts meet, not lines. Records
    of one minute must fit in a task.
    """
    df = with_record_order(records).withColumn("day", jst_date_number(F.col("received_ns"))).withColumn("minute_", F.floor(F.col("received_ns") / (60 * NS)))
    counts = df.groupBy("day", "minute_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("day").orderBy("minute_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("day", "minute_").orderBy("received_ns", "sequence"))
    return df.withColumn("inside_", inside).join(counts.withColumn("before_", before).drop("n_"), ["day", "minute_"]).withColumn("ordinal", F.col("before_") + F.col("inside_")).drop("minute_", "inside_", "before_")


def replay_load(records: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(records of the day with their ordinals, one row: first_ns, last_ns, n and how many lie OUTSIDE_SELECTED_DAY)."""
    inside = jst_date_number(F.col("received_ns")) == F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date"))
    at = F.when(inside, F.col("received_ns"))
    span = records.agg(F.min(at).alias("first_ns"), F.max(at).alias("last_ns"), F.count(at).alias("n"), F.count_if(~inside).alias("outside_selected_day"))
    return replay_order(records.where(inside)), span


_OUTCOME = fragments.OUTCOME


def assembled(parts: DataFrame) -> DataFrame:
    """Complete payloads and failures. Single-part sentences pass in the JVM; only parts of several reach Python."""
    single = parts.where("total = 1").withColumn("code", F.lit(None).cast("string")).select(*_OUTCOME)
    clock = parts.select("received_ns", F.lit(True).alias("is_fragment"))
    return single.unionByName(fragments.assembled_parts(parts.where("total > 1"), clock))


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("mmsi", "message_type", "payload", "fill_bits"), time: str = "received_ns") -> DataFrame:
    """Drop what repeats within a second of its previous occurrence, kept or not."""
    w = Window.partitionBy(*keys).orderBy(time, "sequence")
    before = F.lag(time).over(w)
    return events.withColumn("before_", before).where(F.col("before_").isNull() | (F.col(time) - F.col("before_") > REPEAT_NS)).drop("before_")


def diagnostics(rows: DataFrame, code: str = "code", time: str = "received_ns") -> DataFrame:
    return rows.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.min(time).alias("first_ns"), F.max(time).alias("last_ns"))


def outcomes(lines: DataFrame, source: Column | None = None) -> DataFrame:
    """What became of ``lines(file, line_no, value)``: a decoded event (code null), or the first step's code that stopped it.

    Parts and repeats only meet within a ``source``, one for all lines unless given. Sentences are read out of the lines and written once, when this is called; those that need no assembly,
    the parts of others (see ``fragments``) and the times of all are taken from there, so that the lines are gone through once.
    """
    raw = with_record_order(parsed_lines(lines)).withColumnRenamed("code", "line_code").withColumn("source_id", F.lit("log") if source is None else source)
    framed = saved(nmea.with_envelope(raw).withColumn("code", F.coalesce("line_code", "code")).select(*_OUTCOME, "total", "number", "sequence_id"), "sentences")
    part = F.col("code").isNull() & (F.col("total") > 1)
    clock = framed.where("received_ns IS NOT NULL").select("received_ns", F.col("code").isNull().alias("is_fragment"))
    rows = framed.where(~part).select(*_OUTCOME).unionByName(fragments.assembled_parts(framed.where(part), clock))
    return finished(rows)


def finished(rows: DataFrame) -> DataFrame:
    """Whole payloads decoded and repeats marked; ``rows`` are those of ``fragments.OUTCOME``."""
    read = nmea.decoded(rows.withColumnRenamed("code", "before_decoding")).withColumn("code", F.coalesce("before_decoding", "code"))
    # what has failed repeats nothing: it gets a key of its own
    w = Window.partitionBy("source_id", "mmsi", "message_type", "payload", "fill_bits", F.when(F.col("code").isNotNull(), F.xxhash64("sequence", "received_ns"))).orderBy("received_ns", "sequence")
    repeats = F.col("code").isNull() & (F.col("received_ns") - F.lag("received_ns").over(w) <= REPEAT_NS)
    return read.withColumn("code", F.when(repeats, "DUPLICATE").otherwise(F.col("code"))).drop("before_decoding")


def events_of_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of ``lines(file, line_no, value)``, through all input steps. Who needs both saves ``outcomes`` once."""
    found = outcomes(lines)
    return found.where("code is null").drop("code"), diagnostics(found)
