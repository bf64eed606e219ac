"""Predicted tags against reviewed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import confidence_rank

KEYS = ("doc_id", "path")


def filter_confidence(tags: Column | str, floor: int) -> Column:
    """The tags at or above a confidence rank."""
    return F.filter(F.col(tags) if isinstance(tags, str) else tags, lambda t: confidence_rank(t["confidence"]) >= floor)


def code_sets(objectives: DataFrame, floor: int = 1, ordinal: str | None = None) -> DataFrame:
    """One set of codes per (doc_id, path); the last of rows with the same path counts."""
    codes = F.array_distinct(F.array_compact(F.transform(filter_confidence(F.coalesce("tags", F.array().cast(objectives.schema["tags"].dataType)), floor), lambda t: F.nullif(t["code"], F.lit("")))))
    rows = objectives.where("path is not null").select(*KEYS, codes.alias("codes"), F.col(ordinal).alias("ordinal") if ordinal else F.lit(0).alias("ordinal"))
    return rows.groupBy(*KEYS).agg(F.max_by("codes", "ordinal").alias("codes"))


def pair_objectives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """All paths of either side with both code sets; a missing side is empty."""
    none = F.array().cast("array<string>")
    both = predicted.select(*KEYS, F.col("codes").alias("p")).join(truth.select(*KEYS, F.col("codes").alias("t")), list(KEYS), "full")
    return both.select(*KEYS, F.coalesce("p", none).alias("predicted"), F.coalesce("t", none).alias("truth"))


def pair_documents(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Each document with whether it is on both sides or on which alone."""
    p, t = predicted.select("doc_id").distinct().withColumn("p", F.lit(True)), truth.select("doc_id").distinct().withColumn("t", F.lit(True))
    return p.join(t, "doc_id", "full").select("doc_id", F.when(F.col("p").isNull(), "truth_only").when(F.col("t").isNull(), "predicted_only").otherwise("both").alias("side"))


def compare_code_sets(pairs: DataFrame) -> DataFrame:
    """Common, predicted-only and truth-only codes, sorted, and whether both sets are equal."""
    out = pairs.select(
        *KEYS,
        F.array_sort(F.array_intersect("predicted", "truth")).alias("common"),
        F.array_sort(F.array_except("predicted", "truth")).alias("only_predicted"),
        F.array_sort(F.array_except("truth", "predicted")).alias("only_truth"),
    )
    return out.withColumn("exact", (F.size("only_predicted") == 0) & (F.size("only_truth") == 0))


def precision_recall_f1(compared: DataFrame) -> DataFrame:
    """Per document and, with doc_id null, over all: counts, precision, recall, F1 and the percentage of exact objectives."""
    sums = compared.rollup("doc_id").agg(
        F.count("*").alias("n_objectives"),
        F.count_if("exact").alias("n_exact"),
        F.sum(F.size("common")).alias("tp"),
        F.sum(F.size("only_predicted")).alias("fp"),
        F.sum(F.size("only_truth")).alias("fn"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    out = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r)).withColumn("exact_pct", share(100.0 * F.col("n_exact"), F.col("n_objectives")))
