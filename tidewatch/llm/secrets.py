"""Secret scans over every historical version of every file, through an incremental blob ledger.

A version is a row (path, text). Its blob is the SHA-256 of the text. The ledger is a Parquet folder with one row per
scanned (blob, rule, rule version); a scan reads only the pairs it doesn't hold, appends what it found (an empty list
where nothing was) and joins the findings of all blobs back to all paths. Rerunning a batch appends nothing.

Defined results: a null text is the empty text; rows without findings come back with an empty list; repeated rows each
come back; null paths are kept; an empty table gives no rows; columns besides path and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; kept if ``group`` (0: all) has ``least`` characters."""

    name: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The contract's base rules, in the order in which equal starts are listed, then what this ledger adds. Runs of one
#: character class are maximal, so asking for their length in the pattern finds the same spans as dropping short ones.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}", 16),
    # a body holds no five dashes, so a match never runs on past the next BEGIN line: the rule stays linear
    Rule("pem", 2, r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_FOUND = "array<struct<rank:int,start:bigint,end:bigint>>"
LEDGER_SCHEMA = f"blob string, rule string, found {_FOUND}"
_SPAN = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    ranks = {r.name: k for k, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.key: (r, r.compiled()) for r in rules}
        for batch in batches:
            blobs, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for lo in range(0, len(blobs), 200):
                for blob, text, keys in zip(blobs[lo : lo + 200], batch.column(1).slice(lo, 200).to_pylist(), wanted[lo : lo + 200], strict=True):
                    for key in keys:
                        rule, pattern = compiled[key]
                        out[0].append(blob)
                        out[1].append(key)
                        out[2].append([{"rank": ranks[rule.name], "start": a, "end": b} for a, b in spans_of(text, rule, pattern)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(_SPAN))], names=["blob", "rule", "found"])

    return run


class BlobLedger:
    """The ledger at ``path`` (any folder that Spark reads and writes)."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        """All findings for the rules in their present versions, one row per (blob, rule)."""
        if not self._exists():
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        known = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        return known.where(F.col("rule").isin([r.key for r in self.rules]))

    def pending(self, keyed: DataFrame) -> DataFrame:
        """(blob, path, rules): the unseen pairs by blob, and the one path from which each blob will be read."""
        every = F.array(*[F.lit(r.key) for r in self.rules])
        blobs = keyed.groupBy("blob").agg(F.min_by(F.struct("path"), F.struct(F.col("path").isNull(), "path")).alias("at"))
        if not self._exists():
            return blobs.select("blob", F.col("at.path").alias("path"), every.alias("rules"))
        seen = self.rows().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        return left.where(F.size("rules") > 0).select("blob", F.col("at.path").alias("path"), "rules")

    def scan(self, versions: DataFrame) -> int:
        """Scan the unseen pairs of ``versions(path, text)`` and append them. Returns the number of rows appended."""
        named = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        pending = common.saved(self.pending(named.select("path", "blob")), "ledger-pending")
        # one row per blob is read: the side of blobs is hashed, texts are neither sorted nor grouped by content
        todo = pending.select(F.col("blob").alias("b"), F.col("path").alias("p"), "rules").hint("shuffle_hash")
        texts = named.join(todo, (named.path.eqNullSafe(F.col("p"))) & (named.blob == F.col("b"))).select("blob", "text", "rules")
        if versions.groupBy("path").count().where("count > 1").limit(1).count():  # a version may stand in several rows
            texts = texts.dropDuplicates(["blob"])
        texts.mapInArrow(_scan(self.rules), LEDGER_SCHEMA).write.mode("append").parquet(self.path)
        common.release(self.spark)
        return pending.count()

    def findings(self) -> DataFrame:
        """(blob, found): all spans of a blob by start, then rule order; only blobs that have any."""
        some = self.rows().where(F.size("found") > 0)
        one = some.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("all"))
        by_place = F.transform(F.array_sort(F.transform("all", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end")))), lambda s: s)
        return one.select("blob", by_place.alias("found"))

    def by_path(self, versions: DataFrame) -> DataFrame:
        """Findings of every version: path, blob, found (array of start, rank, end; empty if none)."""
        none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
        keyed = common.saved(versions.select("path", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob")), "versions")
        copies = keyed.groupBy("blob").agg(F.count("*").alias("size_")).join(self.findings(), "blob", "left")
        copies = common.saved(copies.select("blob", "size_", F.coalesce("found", none).alias("found")), "blob-findings")
        return common.join_groups(keyed, copies, ["blob"]).select("path", "blob", "found")


def scan_versions(spark: SparkSession, versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    book = BlobLedger(spark, ledger, rules)
    book.scan(versions)
    return book.by_path(versions)


def _listed(found, names: list[str]):
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def _redact(at: int):
    """Blank the found spans, the last column, in the text at place ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, marked = batch.columns
            out = []
            for text, found in zip(columns[at].to_pylist(), marked.to_pylist(), strict=True):
                if found and text is not None:
                    parts, done = [], 0
                    for s in found:
                        if s["end"] > done:
                            parts += [text[done : max(done, s["start"])], "[SECRET]"] if s["start"] >= done else []
                            done = s["end"]
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
        common.give_back()

    return run


def redact(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by [SECRET]; overlapping spans become one.

    Null texts stay null, rows of blobs that the ledger doesn't know stay as they are, and so do all other columns of any name.
    """
    names = docs.columns
    blob, found = (next(n for n in (f"{w}{k}" for k in range(len(names) + 1)) if n not in names) for w in ("blob_", "found_"))
    marks = ledger.findings().select(F.col("blob").alias(blob), F.col("found").alias(found))
    keyed = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    marked = keyed.join(marks.hint("shuffle_hash"), blob, "left").select(*[f"`{n}`" for n in names], found)
    return marked.mapInArrow(_redact(names.index("text")), docs.schema)


def _count(found, rank: int):
    # a lambda of two parameters, even with a default, would be given the element's index as the second
    return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("bigint")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = scan_versions(spark, docs, common.new_path(spark, "ledger"))
    names, base = [r.name for r in RULES], F.filter("found", lambda s: s["rank"] < len(BASE))
    count = {n: _count("found", k).alias(f"n_{n}") for k, n in enumerate(BASE)}
    return found.select(F.col("path").alias("doc_id"), *count.values(), F.sha2(_listed(base, names), 256).alias("base_sha256"), _listed(F.col("found"), names).alias("spans"))
