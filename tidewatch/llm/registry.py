"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import compression_rules, filter_audit, hard_negatives, html_main, ngram_join, packing, quality, secrets, token_rollups, token_store, trie_bpe, vector_dedup, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
        "op2_token_counts": token_rollups.op2_token_counts,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_token_store": token_store.op4_token_store,
        "op5_bpe_round_trip": trie_bpe.op5_bpe_round_trip,
        "op6_nearest_neighbours": vector_search.op6_nearest_neighbours,
        "op7_packing": packing.op7_packing,
        "op8_html_extraction": html_main.op8_html_extraction,
        "op9_embedding_near_dedup": vector_dedup.op9_embedding_near_dedup,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_quality_rules": compression_rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": token_rollups.OP2_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
