"""From raw documents to packed training sequences: five stages, each over everything that the one before kept.

Defined cases: a null or empty text goes in the first stage; a row without doc_id is a document like others; rows that share a doc_id
are judged each by its own text, and of equal texts one row stays; ties in the classifier's draw stay; texts of any length are
handled whole; a table without rows gives none; columns other than doc_id and text (and n_chars, which follows the text) are
handed on as they are, whatever they are called, up to the last stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import common, near_dedup, packing, quality_classifier, quality_rules, secret_scan


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    common.ship(spark)
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones draws."""
    common.ship(spark)
    return quality_classifier.Resampler(docs, common.read(spark, sf_dir, "labels")).keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies."""
    common.ship(spark)
    return near_dedup.keep_one(docs)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    common.ship(spark)
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, with their ids."""
    common.ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Language models, near-duplicate classes and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written as Parquet to the shared folder and read again, and goes when the next is written."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        if i:
            common.drop(before)
    return docs
