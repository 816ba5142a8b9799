"""Corpus preparation: bad documents go, one of each group of near copies stays, secrets are blanked, the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``docs``; the
last returns packed pieces with their ids. ``run`` writes each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, ngram_join, packing, quality, secrets


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled ones of ``docs``, keep those that score at least the threshold; a null text scores as the empty one."""
    return quality.keep_good(docs, quality.fit_quality(docs, common.read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word Jaccard similarity 0.8 or more, keep the row of its smallest doc_id.

    Rows without a doc_id stay; of several rows under one doc_id one stays. Null and wordless texts are no copies and stay.
    """
    parts = ngram_join.similarity_components(docs)
    heads = parts.where("doc_id = component_id").groupBy("doc_id").count()
    heads = common.saved(heads.select(F.col("doc_id").alias("head_"), (F.col("count") > 1).alias("many_")), "heads")
    kept = docs.join(heads.hint("shuffle_hash"), F.col("doc_id") == F.col("head_"))
    out = kept.where("not many_").select(*docs.columns)
    if heads.where("many_").limit(1).count():
        out = out.unionByName(kept.where("many_").dropDuplicates(["doc_id"]).select(*docs.columns))
    return out.unionByName(docs.where("doc_id is null"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scan the texts through a blob ledger and replace what is found; n_chars follows the text."""
    ledger = secrets.BlobLedger(spark, common.new_path(spark, "ledger"))
    ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    clean = secrets.redact(docs, ledger)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with these ids; a null text is packed as the empty one, its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=True)


STAGES = [("quality_classifier", classify_quality), ("ngram_jaccard_join", drop_near_copies), ("secret_scans", blank_secrets), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
