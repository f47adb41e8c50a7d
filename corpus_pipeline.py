"""From raw documents to packed training sequences: the stages, in order, over what their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Documents whose
id is null can't be related to others, so line dedup and the n-gram join leave them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import decontamination, line_dedup, ngram_join, packing, quality
from strataweave.llm.text import ready


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is learnt on these documents and the labels."""
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.only_accepted(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents of which nothing is left."""
    return line_dedup.without_lines(docs, line_dedup.removed_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by similar pairs, that with the smallest doc_id stays."""
    return ngram_join.without_copies(docs, ngram_join.classes(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in bins of the model's context length."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, fingerprints and packing; tests/llm/test_pipeline.py compares the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; between them the documents are written to the folder in spark.checkpoint.dir."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
