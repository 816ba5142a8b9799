"""Log files as lines, their catalog by day, copies among them and the fingerprint of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.cube import jst_day
from tidewatch.operators.ingest import parsed_lines


BLOCK_LINES = 1024


def read_lines(spark: SparkSession, root: str | list[str], exact_ends: bool = False) -> DataFrame:
    """(file, line_no, value) of all log files below ``root``; .gz is decoded by its name.

    ``line_no`` is (split, row): it orders the lines of a file without bringing a file into one task. ``exact_ends``: only a line feed ends a
    line, so that a carriage return stays in the value and in the file's digest.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    raw = (reader.option("lineSep", "\n") if exact_ends else reader).text(root)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), row.alias("row")).alias("line_no"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with their place in the file from 0, ``place``: splits are counted, and a line's row is shifted by the splits before."""
    line = lines.schema["line_no"].dataType
    split, row = (F.col("line_no.split"), F.col("line_no.row")) if isinstance(line, T.StructType) else (F.lit(0).cast("bigint"), F.col("line_no").cast("bigint"))
    df = lines.withColumns({"split_": split, "row_": row})
    counts = df.groupBy("file", "split_").agg(F.count("*").alias("n_"), F.min("row_").alias("low_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file").orderBy("split_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("file", "split_", (before - F.col("low_")).alias("shift_"))
    return df.join(shifts, ["file", "split_"]).withColumn("place", F.col("row_") + F.col("shift_")).drop("split_", "row_", "shift_")


def catalog(lines: DataFrame) -> DataFrame:
    """Per file: day of the first line that parses (null: unclassified), lines, bytes, and a digest of its uncompressed lines in their order.

    The digest is a tree of SHA-256: of each line, of the digests of ``BLOCK_LINES`` lines, of a file's blocks. Of a line 32 bytes
    move, and what meets in a task is a block, or a file's 32 bytes for each block. Whether the last line ends with a line feed isn't seen.
    """
    df = numbered(lines).withColumn("line_digest_", F.sha2("value", 256)).withColumn("bytes_", F.octet_length("value") + 1).withColumn("value", F.regexp_replace("value", "\r$", ""))
    df = parsed_lines(df)
    first = F.min(F.when(F.col("code").isNull(), F.struct("place", "received_ns")))
    tied = lambda at, digest: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, digest))), lambda x: x[digest]), ""), 256)
    blocks = df.groupBy("file", F.floor(F.col("place") / BLOCK_LINES).alias("block_")).agg(tied("place", "line_digest_").alias("block_digest_"), first.alias("first_"), F.count("*").alias("n_"), F.sum("bytes_").alias("b_"))
    out = blocks.groupBy("file").agg(tied("block_", "block_digest_").alias("digest"), F.min("first_").alias("first_"), F.sum("n_").alias("n_lines"), F.sum("b_").alias("n_chars"))
    first_ns = F.col("first_.received_ns")
    return out.select("file", F.when(first_ns.isNotNull(), jst_day(first_ns)).alias("day"), "n_lines", "n_chars", "digest")


def drop_repeats_counted(lines: DataFrame, target_types: tuple[int, ...] = (1, 2, 3, 5, 18)) -> tuple[DataFrame, DataFrame]:
    """(lines without exact repeats, per file: total, duplicate, invalid and target lines).

    A line is invalid if it has no time stamp and sentence, and a target if the first character of its payload is that of a wanted type. The
    counts and the rest come out of one grouping by (file, line), which combines before it shuffles.
    """
    from tidewatch.functions import nmea

    kept = lines.groupBy("file", "value").agg(F.min("line_no").alias("line_no"), F.count("*").alias("times"))
    read = parsed_lines(kept)
    kind = F.instr(F.lit(nmea.ARMOUR), F.left(F.get(F.split("sentence", ","), F.lit(5)), F.lit(1))) - 1
    good = F.col("code").isNull()
    counts = read.groupBy("file").agg(
        F.sum("times").alias("total"), F.sum(F.col("times") - 1).alias("duplicate"), F.coalesce(F.sum(F.when(~good, 1)), F.lit(0)).alias("invalid"), F.count_if(good & kind.isin(*target_types)).alias("target"))
    return kept.select("file", "line_no", "value"), counts


def without_counterparts(files: DataFrame, same_content: bool = True) -> DataFrame:
    """Of a plain file and its .gz one stays: the first by name if both hold the same, or always the .gz if contents don't matter."""
    stem = F.regexp_replace("file", r"(?i)\.gz$", "")
    keyed = files.withColumn("stem", stem)
    if same_content:
        firsts = keyed.groupBy("stem", "digest").agg(F.min("file").alias("kept"))
        return keyed.join(firsts, ["stem", "digest"]).where("file = kept").select(*files.columns)
    packed = keyed.where(F.col("file") != F.col("stem")).select("stem")
    plain = keyed.where(F.col("file") == F.col("stem")).join(packed, "stem", "left_anti")
    return plain.select(*files.columns).unionByName(keyed.where(F.col("file") != F.col("stem")).select(*files.columns))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the files' digests in path order, characters and number of files. A row per file meets, no line."""
    listed = F.array_sort(F.collect_list(F.struct("file", "n_chars", "digest")))
    text = F.array_join(F.transform(listed, lambda f: F.concat_ws(":", f["n_chars"].cast("string"), f["digest"])), ",")
    return files.agg(F.sha2(text, 256).alias("fingerprint"), F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_files"))


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """Exact repeats of a line within its file go; the first stays."""
    return lines.groupBy("file", "value").agg(F.min("line_no").alias("line_no")).select("file", "line_no", "value")


def coverage(files: DataFrame, first: str, last: str) -> DataFrame:
    """Every calendar day with its number of files and characters, missing days included."""
    days = files.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    have = files.groupBy("day").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))
    return days.join(have, "day", "left").fillna(0, ["n_files", "n_chars"]).withColumn("missing", F.col("n_files") == 0)


def archive(files: DataFrame) -> DataFrame:
    """Files named YYMMDD-part.ais or .ais.gz out of ``files(file, n_bytes)``: day, part, whether packed; other names and impossible dates are left out."""
    name = F.element_at(F.split("file", "/"), -1)
    pattern = r"(?i)^([0-9]{6})-([0-9]+)[.]ais([.]gz)?$"
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(name, pattern, 1)), F.lit("yyyyMMdd")).cast("date")
    found = files.where(name.rlike(pattern)).select("file", "n_bytes", day.alias("day"), F.regexp_extract(name, pattern, 2).cast("int").alias("part"), (F.regexp_extract(name, pattern, 3) != "").alias("packed"))
    return found.where("day IS NOT NULL")


def archive_days(found: DataFrame) -> DataFrame:
    """Per day of an ``archive``: files, bytes, parts (several: a multipart date), and parts that are there both plain and packed."""
    parts = found.groupBy("day", "part").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"), F.count_if("packed").alias("p"))
    return parts.groupBy("day").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.count("*").alias("parts"), F.count_if((F.col("p") > 0) & (F.col("n") > F.col("p"))).alias("overlaps")).withColumn("multipart", F.col("parts") > 1)


def archive_span(found: DataFrame) -> DataFrame:
    """One row: first and last day, days with files, calendar days, and how many of these are missing, multipart or overlapping; bytes."""
    days = archive_days(found)
    out = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.count_if("multipart").alias("multipart_days"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    span = F.coalesce(F.datediff("last_day", "first_day") + 1, F.lit(0))
    return out.withColumn("calendar_days", span).withColumn("missing_days", span - F.col("days"))
