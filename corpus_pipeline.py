"""The corpus pipeline: five stages, each one operator over all that the one before kept.

language_id    drops documents in which no language is found, or none clearly
line_dedup     cuts lines that equal or resemble an earlier line; no document goes
near_dedup     keeps one document, the one with the smallest id, of each near-duplicate group
chunk_dedup    cuts passages that an earlier document holds; no document goes
packing        packs what is left into sequences of at most 2048 tokens

A stage takes (spark, docs, sf_dir) and returns the columns of docs, the last one a row for
each packed piece. Null texts have no language and go in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.llm import chunk_dedup, kernel_langid, line_dedup, simhash, vector_packing
from atelier.llm.common import discard, fresh, written

#: Least score at which a text counts as written in a language.
LEAST_LANGUAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents of docs; documents without a language,
    or whose best language scores under LEAST_LANGUAGE, go. Columns of docs that are named as
    the results stay as they are."""
    names = {c: fresh(f"own_{i}", docs) if c.lower() in kernel_langid.RESULTS else c for i, c in enumerate(docs.columns)}
    found = kernel_langid.identify(docs.withColumnsRenamed({a: b for a, b in names.items() if a != b}))
    kept = found.where((F.col("lang_pred") != kernel_langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select(*[F.col(f"`{b}`").alias(a) for a, b in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share at least 0.8 of their five-word shingles, directly
    or by way of others, one row stays: that of the smallest id, a row without an id last."""
    return simhash.without_similar(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup.without_repeats(docs)),
    ("near_dedup", near_dedup),
    ("chunk_dedup", lambda spark, docs, sf_dir: chunk_dedup.without_repeats(docs)),
    ("packing", lambda spark, docs, sf_dir: vector_packing.pack(docs)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, last, sf_dir), name)
        if hasattr(last, "_written"):
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, fingerprints and kernels have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None
