"""Block products and pruned lists give the rows of the join on terms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import bounded, matrix, pruned
from tagweave.operators import tfidf as T
from tagweave.operators.pruned import PrunedTopK, impact_index
from tagweave.plans.shared import stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    deal = random.Random(2)
    words = [f"w{int(deal.paretovariate(0.7))}" for _ in range(4000)]

    def texts(n, longest):
        return [None if i == 3 else "" if i == 4 else " ".join(deal.choices(words, k=deal.randint(1, longest))) for i in range(n)]

    queries = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(texts(60, 30))], "query_id long, subject string, text string")
    corpus = spark.createDataFrame([(f"r{i}", 500 - i, "abc"[i % 3], t) for i, t in enumerate(texts(300, 80))], "record_id string, ord long, subject string, text string")
    return queries, corpus


@pytest.mark.parametrize("pad", [True, False])
@pytest.mark.parametrize("by, own", [((), True), (("subject",), True), (("subject",), False)])
def test_matrix_equals_join(sides, monkeypatch, pad, by, own):
    monkeypatch.setattr(matrix, "BLOCK_RECORDS", 64)
    monkeypatch.setattr(matrix, "BATCH_TERMS", 500)
    queries, corpus = sides
    queries = queries if own else queries.drop("subject")
    columns = [*by, "query_id", "record_id", "ord", "score", "rank"]
    joined, product = (rows(T.shortlist(queries, corpus, 7, by=by, pad=pad, method=m).select(columns)) for m in ("join", "matrix"))
    assert product == joined and (not pad or len(joined) == 60 * 7 * (1 if own or not by else 3))


def test_matrix_scores_equal_cosine_scores(sides):
    queries, corpus = sides
    postings, idf = T.fit_tfidf(corpus)
    want = T.cosine_scores(T.transform_tfidf(queries, idf), postings)
    assert rows(T.matrix_scores(queries, corpus).withColumn("score", F.round("score", 9))) == rows(want.withColumn("score", F.round("score", 9)))


def test_large_corpora_are_not_broadcast(sides, monkeypatch):
    queries, corpus = sides
    monkeypatch.setattr(matrix, "MAX_TEXT_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        T.shortlist(queries, corpus, 3, method="matrix")
    assert T.shortlist(queries, corpus, 3, method="auto").count() == 180


def test_empty_sides(sides):
    queries, corpus = sides
    assert T.shortlist(queries.limit(0), corpus, 3, method="matrix").count() == 0
    assert T.shortlist(queries, corpus.limit(0), 3, method="matrix").count() == 0


@pytest.mark.parametrize("k", [1, 5, 400])
def test_pruned_equals_join(sides, k):
    queries, corpus = sides
    postings, idf = T.fit_tfidf(corpus)
    vectors = T.transform_tfidf(queries, idf)
    index = impact_index(T.attach_fields(postings, corpus, ["ord"]))
    job = PrunedTopK(vectors, index, k, store=lambda df: df.cache())
    columns = ["query_id", "record_id", "ord", "score", "rank"]
    assert rows(job.result().select(columns)) == rows(T.shortlist(queries, corpus, k, pad=False).select(columns))
    work = job.work().first()
    assert work.joined <= work.every and (k > 1 or work.joined < 0.9 * work.every)


def test_pruned_lists_by_subject(sides):
    queries, corpus = sides
    postings, idf = T.fit_tfidf(corpus, by=["subject"])
    vectors = T.transform_tfidf(queries, idf, by=["subject"])
    index = impact_index(T.attach_fields(postings, corpus, ["ord"], by=["subject"]), by=["subject"])
    job = PrunedTopK(vectors, index, 3, by=["subject"], store=lambda df: df.cache())
    columns = ["subject", "query_id", "record_id", "score", "rank"]
    assert rows(job.result().select(columns)) == rows(T.shortlist(queries, corpus, 3, by=["subject"], pad=False).select(columns))


@pytest.mark.parametrize("k, bits", [(1, 3), (5, 0), (400, 13)])
def test_bounded_lists_equal_join(sides, monkeypatch, k, bits):
    """Few counters that all terms share, rows sent in parts, terms of open records counted in parts; copies, and a record of several rows."""
    monkeypatch.setattr(pruned, "MAX_SENT", 5000 if k == 1 else 100_000)
    queries, corpus = sides
    corpus = corpus.select("record_id", F.col("record_id").alias("ord"), "text")
    copies = corpus.where("ord < 'r120'").select(F.concat(F.col("record_id"), F.lit("c")).alias("record_id"), F.concat(F.col("ord"), F.lit("c")).alias("ord"), "text")
    corpus = corpus.unionByName(copies).unionByName(corpus.where("ord in ('r7', 'r90')"))
    terms = T.term_counts(queries, "query_id", "text").select("term").distinct()
    fit = bounded.BoundedIndex(corpus, terms, store=stored, bits=bits)
    monkeypatch.setattr(bounded, "MAX_TERMS", 700 if k == 5 else 1_000_000)
    job = PrunedTopK(T.transform_tfidf(queries, fit.idf), fit.index, k, store=stored, bounded=fit)
    postings, idf = T.fit_tfidf(corpus)
    scores = T.cosine_scores(T.transform_tfidf(queries, idf), postings).withColumn("score", F.round("score", 9))
    columns = ["query_id", "record_id", "score", "rank"]
    assert rows(job.result().select(columns)) == rows(T.top_k(scores, ["query_id"], [F.desc("score"), F.asc("record_id")], k).select(columns))


def test_bounded_lists_of_nothing(sides):
    queries, corpus = sides
    corpus = corpus.drop("subject")
    for asked, known in ((queries, corpus.limit(0)), (queries.limit(0), corpus)):
        terms = T.term_counts(asked, "query_id", "text").select("term").distinct()
        fit = bounded.BoundedIndex(known, terms, store=stored)
        assert PrunedTopK(T.transform_tfidf(asked, fit.idf), fit.index, 3, store=stored, bounded=fit).result().isEmpty()


def test_levels_are_no_less_than_counts():
    counts = np.concatenate([np.arange(5000), 2 ** np.arange(31) + 1, 2 ** np.arange(31) - 1])
    assert (bounded._most(bounded._levels(counts)) >= counts).all() and (bounded._most(bounded._levels(counts)) <= np.maximum(1, counts * 1.1)).all()
