"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import conversation_repair, decontamination, embedding_dedup, lexical_search, line_dedup, packing, quality_rules, secret_scan, sharding, simhash_dedup, suffix_dedup, url_filter, window_dedup
from tallystone.llm.common import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.judged(table(spark, folder, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.judged(table(spark, folder, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, quality_rules.learned(docs, table(spark, folder, "labels")))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents").select("doc_id", "source", "text"))


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.linked(table(spark, folder, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.judged(table(spark, folder, "documents").select("doc_id", "source", "text"))


def op8_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.judged(table(spark, folder, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages").select("page_id", "url"), url_filter.rule_table(spark))


def op11_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.searched(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.judged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_suffix_dedup,
        op3_quality_rules,
        op4_sharding,
        op5_simhash_dedup,
        op6_decontamination,
        op7_secret_scan,
        op8_window_dedup,
        op9_packing,
        op10_url_filter,
        op11_embedding_dedup,
        op12_lexical_search,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontamination.ORACLE,
        "op8_window_dedup": window_dedup.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
        "op11_embedding_dedup": embedding_dedup.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
        "op13_conversation_repair": conversation_repair.ORACLE,
    }
