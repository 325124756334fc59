"""Queries of this folder: one per operator, over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, chat, exact_dedup, html_main, lexical, minhash, mixing, packing, quality, simhash, substring_dedup, topk, training_order,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order_digests(_table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_events(_table(spark, sf_dir, "conversations"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(_table(spark, sf_dir, "documents"))


def op12_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_documents(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_training_order, op2_exact_topk, op3_substring_dedup, op4_mix_sources, op5_main_text, op6_exact_dedup, op7_tool_links,
        op8_simhash_groups, op9_quality_scores, op10_pack_documents, op11_align_tokens, op12_minhash_groups, op13_ranked_search,
    )
}

ORACLES: dict[str, str] = {
    "op2_exact_topk": topk.SQL, "op3_substring_dedup": substring_dedup.SQL, "op4_mix_sources": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL, "op7_tool_links": chat.SQL,
    "op12_minhash_groups": minhash.SQL, "op13_ranked_search": lexical.SQL,
}
