"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chat, hard_negatives, html_text, lexical_search, mixing, near_copies, quality, repeats, secret_scan, token_counts, vector_search, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1,
    "op2_kd_tree_top_k": vector_search.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_prefix_doubling": repeats.op5,
    "op6_token_counts": token_counts.op6,
    "op7_source_mix": mixing.op7,
    "op8_tool_calls": chat.op8,
    "op9_jaccard_join": near_copies.op9,
    "op10_html_text": html_text.op10,
    "op11_lexical_search": lexical_search.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_word_bpe": word_bpe.op13,
}

SQL: dict[str, str] = {"op2_kd_tree_top_k": vector_search.OP2_SQL, "op11_lexical_search": lexical_search.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
