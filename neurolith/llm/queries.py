"""The corpus operators' queries, op1 to op13 and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from neurolith.llm import jaccard_join, lexical_search, line_cleaning, line_dedup, mixing, ngram_lm, packing, prefix_trie, secrets, sharding, suffix_dedup, toxicity, vp_search
from neurolith.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.quality_rules(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.search_embeddings(table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_lm_scoring, op4_quality, op5_secrets, op6_packing, op7_toxicity, op8_jaccard_join, op9_suffix_dedup, op10_neighbours, op11_line_dedup, op12_lexical_search, op13_prefix_trie)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op1_mixing": mixing.oracle(), "op4_quality": line_cleaning.oracle(), "op10_neighbours": vp_search.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
