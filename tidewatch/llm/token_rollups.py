"""Token counts as delta-maintained rollups.

A change is a row (op, source, lang, tokenizer, n_tokens, old_tokens): an insert adds a document and its tokens, a
delete takes them away, a revision replaces ``old_tokens`` by ``n_tokens``; an optional column ``times`` says how often. A batch of changes is summed to signed deltas
by (source, lang, tokenizer), in each map task first, and committed as one folder under its batch id. Committing a batch
again replaces its folder, so replays don't count twice; totals are the sum of all committed deltas. ``compact`` folds
committed batches into one base and remembers their ids, so that a late replay of one of them is ignored.

Defined results: null source, lang or tokenizer are groups of their own; null counts are 0; groups whose totals are all
zero are left out; an empty batch commits nothing but its id; further columns are ignored; a row that stands twice in a
batch counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.tokenization import encoder

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"

#: Tokenizer versions that count by pattern: maximal runs without ASCII white space; letters, digits or single marks.
PATTERNS = {"words@1": r"[^\x20\x09-\x0D]+", "pieces@1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def token_count(text: Column, tokenizer: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PATTERNS[tokenizer])).cast("bigint")


def library_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of every row of ``docs``, counted with the tokenizer file at ``path``; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                counts = pa.array([len(x) // 4 for x in encoder(path).encode(part.column(3))], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], counts], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes`` by key."""
    new, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    times = F.coalesce(F.col("times"), F.lit(0)) if "times" in changes.columns else F.lit(1)
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs * times).cast("bigint").alias("n_docs"), F.sum(tokens * times).cast("bigint").alias("n_tokens"))


class TokenRollup:
    """Totals kept under ``path``, any folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """Ids of the batches that have been committed and not yet compacted."""
        fs, p = self._fs(f"{self.path}/deltas")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self._fs(f"{n.toString()}/_SUCCESS")[1])]
        return sorted(n.getName().removeprefix("batch=") for n in done)

    def folded(self) -> list[str]:
        """Ids of the batches that the base already holds."""
        base = self._newest_base()
        return [] if base is None else [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()]

    def _newest_base(self) -> str | None:
        fs, p = self._fs(f"{self.path}/bases")
        if not fs.exists(p):
            return None
        whole = [s.getPath().toString() for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath().toString()}/batches/_SUCCESS")[1])]
        return max(whole, default=None)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` as ``batch``; False if a compaction already holds that batch."""
        if batch in self.folded():
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        return True

    def _signed(self) -> DataFrame:
        base, done = self._newest_base(), set(self.committed())
        fields = ", ".join(DELTAS.split(", ")[:-1])
        parts = [self.spark.read.schema(fields).parquet(f"{self.path}/deltas/batch={b}") for b in sorted(done - set(self.folded()))]
        if base is not None:
            parts.append(self.spark.read.schema(fields).parquet(f"{base}/totals"))
        out = self.spark.createDataFrame([], fields)
        for p in parts:
            out = out.unionByName(p)
        return out

    def totals(self) -> DataFrame:
        sums = self._signed().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Write a new base; its list of batches is written last and makes it valid."""
        base, batches = self._newest_base(), sorted({*self.committed(), *self.folded()})
        number = int(base.rpartition("/")[2]) + 1 if base else 0
        at = f"{self.path}/bases/{number:012d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
        for b in self.committed():
            common.remove(self.spark, f"{self.path}/deltas/batch={b}")


def changes_of(rows: DataFrame, op: str, tokenizer: str, tokens: Column, old: Column | None = None, times: Column | None = None) -> DataFrame:
    old, times = old if old is not None else F.lit(0), times if times is not None else F.lit(1)
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.cast("bigint").alias("n_tokens"), old.cast("bigint").alias("old_tokens"), times.alias("times"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: every document comes in; copies of a text go, but the first one by
    doc_id (nulls last), source and lang; what stays comes in under a second tokenizer with an estimate; the estimates are
    revised. One batch is replayed. Of equal rows one stays; a null text is the empty text."""
    docs = common.read_table(spark, sf_dir, "documents")
    text, own = F.coalesce(F.col("text"), F.lit("")), ["h", "doc_id", "source", "lang"]
    counted = docs.select("doc_id", "source", "lang", F.sha2(text, 256).alias("h"), token_count(F.col("text"), "words@1").alias("words"), token_count(F.col("text"), "pieces@1").alias("pieces"), F.ceil(F.length(text) / 4).cast("bigint").alias("guess"))
    counted = common.saved(counted.groupBy(*own).agg(F.count("*").alias("rows"), *[F.min(c).alias(c) for c in ("words", "pieces", "guess")]), "document-counts")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "source", "lang")
    first = common.saved(counted.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("size_")), "first-copies")
    marked = common.join_groups(counted, first, ["h"]).withColumn("stays", order.eqNullSafe(F.col("first")))
    kept = marked.where("stays")
    book = TokenRollup(spark, common.new_path(spark, "rollup"))
    book.commit("1", changes_of(counted, "insert", "words@1", F.col("words"), times=F.col("rows")))
    copies = changes_of(marked, "delete", "words@1", F.col("words"), times=F.col("rows") - F.col("stays").cast("int"))
    book.commit("2", copies)
    book.commit("3", changes_of(kept, "insert", "pieces@1", F.col("guess")))
    book.commit("2", copies)
    book.compact()
    book.commit("4", changes_of(kept, "revise", "pieces@1", F.col("pieces"), F.col("guess")))
    return book.totals()


OP2_SQL = r"""
WITH texts AS (SELECT source, lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nth FROM documents)
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM texts WHERE nth = 1 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces@1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))) AS BIGINT) AS n_tokens
FROM texts WHERE nth = 1 GROUP BY source, lang
"""
