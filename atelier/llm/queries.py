"""The corpus queries: each applies one operator, with its production parameters, to a whole
table. SQL stands beside the operator where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atelier.llm import (
    chunk_dedup,
    fill_in_middle,
    hard_negatives,
    host_rules,
    kernel_langid,
    line_dedup,
    mix_lm,
    multi_index,
    simhash,
    toxicity,
    tree_bpe,
    vector_packing,
    viterbi_counts,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.linked_lines(_table(spark, sf_dir, "documents"))


def op2_mix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_lm.score(_table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.spans(_table(spark, sf_dir, "documents"))


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return viterbi_counts.count_tokens(docs).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op7_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernel_langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(_table(spark, sf_dir, "documents"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows, rows.where("vec_id % 50 = 0"))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.digests(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, _table(spark, sf_dir, "labels")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_dedup, op2_mix_lm, op3_chunk_dedup, op4_viterbi_counts, op5_simhash,
        op6_host_rules, op7_kernel_langid, op8_vector_packing, op9_multi_index, op10_tree_bpe,
        op11_hard_negatives, op12_fill_in_middle, op13_toxicity,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op6_host_rules": host_rules.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_fill_in_middle": fill_in_middle.ORACLE,
    }
