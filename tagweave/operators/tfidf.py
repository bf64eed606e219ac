"""Retrieval of taxonomy records by TF-IDF cosine similarity.

Every job takes grouping columns `by`, such as subject: each group is a corpus of its own, with its own size, idf and lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams
from . import matrix

TOP_K = 15


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row per (key, term) with the term's count; all terms of a key are in one partition, so what follows by key needs no shuffle."""
    keys = [*by, key]
    return df.select(*keys, text).repartition(*keys).select(*keys, F.explode(ngrams(text, stop_words)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _unit(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def fit_tfidf(
    corpus: DataFrame, key: str = "record_id", text: str = "text", stop_words: Sequence[str] = (), by: Sequence[str] = (), terms: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(postings, idf and df of terms): tf 1 + ln(tf), smooth idf ln((1 + N) / (1 + df)) + 1, rows of unit length.

    With `terms`, all that will be asked, only postings of these are made, with the norms of whole records. `store` keeps the idf for both uses."""
    keys = [*by, key]
    counts = term_counts(corpus, key, text, stop_words, by)
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df"))
    if by:
        df, total = df.join(corpus.groupBy(*by).agg(F.count("*").alias("total")), [*by]), F.col("total")
    else:
        total = corpus.agg(F.count("*")).scalar()
    idf = df.select(*by, "term", "df", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = store(idf)
    weighted = counts.join(idf, [*by, "term"]).select(*keys, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    if terms is None:
        return _unit(weighted, keys), idf
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(terms, [*by, "term"], "left_semi").join(norms, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def transform_tfidf(queries: DataFrame, idf: DataFrame, key: str = "query_id", text: str = "text", stop_words: Sequence[str] = (), by: Sequence[str] = (), method: str = "join") -> DataFrame:
    """Unit rows of the queries under a fitted idf; terms that the corpus does not have are dropped before the norm.

    Queries without the columns of `by` are asked in every group: their terms are counted once and weighed in each.
    `method` is "join", or "auto": a small idf without groups, which is measured, is sent to workers that weigh text by text."""
    if method == "auto" and not by and matrix.idf_fits(idf):
        return matrix.unit_rows(queries, idf, key, text, stop_words)
    keys, own = [*by, key], [c for c in by if c in queries.columns]
    counts = term_counts(queries, key, text, stop_words, own)
    return _unit(counts.join(idf, [*own, "term"]).select(*keys, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")), keys)


def cosine_scores(queries: DataFrame, postings: DataFrame, query_key: str = "query_id", key: str = "record_id", by: Sequence[str] = ()) -> DataFrame:
    """Similarity of each query and record that share a term."""
    other = postings.select(*by, key, "term", F.col("weight").alias("record_weight"))
    return queries.join(other, [*by, "term"]).groupBy(*by, query_key, key).agg(F.sum(F.col("weight") * F.col("record_weight")).alias("score"))


def all_scores(queries: DataFrame, corpus: DataFrame, query_key: str = "query_id", key: str = "record_id", order: str = "ord", stop_words: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The rows of cosine_scores() for texts: from block products, which shuffle no pairs, where the corpus is measured as small enough, else from the join."""
    if matrix.fits(corpus):
        return matrix_scores(queries, corpus, query_key, key, order, stop_words, by)
    postings, idf = fit_tfidf(corpus, key, "text", stop_words, by)
    return cosine_scores(transform_tfidf(queries, idf, query_key, "text", stop_words, by), postings, query_key, key, by)


def matrix_scores(queries: DataFrame, corpus: DataFrame, query_key: str = "query_id", key: str = "record_id", order: str = "ord", stop_words: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The rows of cosine_scores() from block products; `corpus` as in shortlist()."""
    if not matrix.fits(corpus):
        raise ValueError("the corpus is too large to be broadcast; use cosine_scores()")
    every = matrix.best_records(queries, term_counts(corpus, key, "text", stop_words, by), corpus, matrix.MAX_RECORDS, query_key, key, order, stop_words, list(by), None, False)
    return every.select(*by, query_key, key, "score")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = TOP_K) -> DataFrame:
    """The first k rows of each key in a given order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def pad_zero(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_key: str = "query_id", key: str = "record_id", order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """Makes each query's list k rows long with records of score 0, in corpus order. At most the first 2k records can be needed."""
    keys = [*by, query_key]
    have = found.groupBy(*keys).agg(F.collect_set(key).alias("have"), F.count("*").alias("n"))
    asked = queries.select(*(c for c in keys if c in queries.columns))
    if missing := [c for c in by if c not in queries.columns]:
        own = [c for c in by if c not in missing]
        groups = corpus.select(*own, F.struct(*missing).alias("_group")).distinct()
        if own:
            asked = asked.join(groups, own)
        else:  # each query is asked in every group: few, as each is a corpus
            asked = asked.withColumn("_groups", groups.agg(F.collect_list("_group")).scalar()).withColumn("_group", F.explode("_groups"))
        asked = asked.select(*(c for c in keys if c not in missing), *(F.col(f"_group.{c}").alias(c) for c in missing))
    short = asked.join(have, keys, "left").where(F.coalesce("n", F.lit(0)) < k)
    if by:
        first = top_k(corpus.select(*by, order, key), by, [F.asc(order)], 2 * k).groupBy(*by).agg(F.collect_list(F.struct(order, key)).alias("first"))
        short, records = short.join(first, [*by]), F.col("first")
    else:
        records = corpus.orderBy(order).limit(2 * k).agg(F.collect_list(F.struct(order, key)).alias("first")).scalar()
    spare = short.select(*keys, "have", F.explode(F.sort_array(records)).alias("r")).select(*keys, "have", f"r.{key}", f"r.{order}")
    spare = spare.where(~F.array_contains(F.coalesce("have", F.array().cast(have.schema["have"].dataType)), F.col(key))).select(*keys, key, F.lit(0.0).alias("score"), order)
    return top_k(found.select(*keys, key, "score", order).unionByName(spare), keys, [F.desc("score"), F.asc(order)], k)


def attach_fields(ranked: DataFrame, corpus: DataFrame, fields: Sequence[str], key: str = "record_id", by: Sequence[str] = ()) -> DataFrame:
    """Ranked rows with fields of their record."""
    return ranked.join(corpus.select(*by, key, *fields), [*by, key])


def shortlist(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_key: str = "query_id", key: str = "record_id", order: str = "ord", stop_words: Sequence[str] = (), digits: int = 9, by: Sequence[str] = (), pad: bool = True, method: str = "join") -> DataFrame:
    """The k best records of each query, in each group of `by` that it is asked in, with `pad` as many of score 0 as k lacks; scores are rounded before
    ranking so that ties fall in corpus order. Postings carry that order and their term's idf and df, so the queries' terms are joined once, and
    their norms follow from the joined rows: a term with df records stands in df of them.

    `corpus` has key, order and text, `queries` key and text; `corpus` has the columns of `by`, and queries without them are asked in every group.
    `method` is "join" (terms are joined, for corpora of any size), "matrix" (block products in workers that all get the corpus, which
    is refused if it is too large for that) or "auto": matrix where the corpus, which is measured, is small enough, else join."""
    if method != "join":
        if matrix.fits(corpus):
            return matrix.best_records(queries, term_counts(corpus, key, "text", stop_words, by), corpus, k, query_key, key, order, stop_words, list(by), digits, pad)
        if method == "matrix":
            raise ValueError("the corpus is too large to be broadcast; use the join")
    postings, idf = fit_tfidf(corpus, key, "text", stop_words, by)
    placed = attach_fields(postings, corpus, [order], key, by).join(idf, [*by, "term"])
    own = [c for c in by if c in queries.columns]
    w = (1 + F.log("tf")) * F.col("idf")
    pairs = term_counts(queries, query_key, "text", stop_words, own).join(placed, [*own, "term"]).groupBy(*by, query_key, key, order)
    summed = pairs.agg(F.sum(w * F.col("weight")).alias("dot"), F.sum(w * w / F.col("df")).alias("part"))
    norm = F.sqrt(F.sum("part").over(Window.partitionBy(*by, query_key)))
    scores = summed.select(*by, query_key, key, order, F.round(F.col("dot") / norm, digits).alias("score"))
    best = top_k(scores, [*by, query_key], [F.desc("score"), F.asc(order)], k)
    return pad_zero(best, queries, corpus, k, query_key, key, order, by) if pad else best
