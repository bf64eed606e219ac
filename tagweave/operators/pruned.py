"""Exact top-k over large corpora that leaves out pairs which cannot reach a query's k-th score.

Records fall into classes by their largest weight, part of an octave each, so that long records with small weights are apart from short ones.
Postings lie in blocks by impact: a block holds a term's postings of one class and one half-octave of weight, so it needs no order
and a frequent term is never gathered. Of each block its largest weight is known, so a query's weight times that bounds what the
block can add to any record. For each query

1. its strongest blocks, up to a few times k postings, lead to records that are scored in full; their k-th score is a threshold
   that the true one reaches;
2. in each class, blocks are taken in rising order of their bounds while all of them together, in one record, stay under the threshold:
   by the sum of bounds (of each term the largest), or by the length of the query's part, as records have unit length. A record
   of the class that is in none of the other blocks cannot reach the threshold, so only the other blocks are joined;
3. records whose sum there and the bound of the rest stay under the threshold go too, and what is left is scored in full.

With an index that knows bounds of its records' norms alone (bounded.py), weights and sums are upper bounds and the threshold comes from lower
ones; records that may still be among the k best get their norms at the end.

The rows are those of tfidf.shortlist() without padding.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels, and classes, for each halving of a weight.
PER_OCTAVE = 2
#: Postings that lead to the first threshold, besides so many times k of them, and the largest block that takes part, in units of k.
FIRST_POSTINGS, FIRST_BLOCK = 200, 64
#: Records that are scored in full for it, besides so many times k of them.
FIRST_RECORDS = 50
TIMES_K = 8
#: Rows of queries that go to the workers at once, so that the index stays where it lies.
MAX_SENT = 1_000_000
#: Bounds are compared with this slack, as scores are rounded before they are ranked.
SLACK = 1e-8


def impact_index(postings: DataFrame, key: str = "record_id", by: Sequence[str] = (), most: str | None = None) -> DataFrame:
    """Postings with the level of their weight and the class of their record: part of an octave each, the strongest lowest.

    `most` names a column with the largest weight of the record, if there is one."""

    def octaves(weight: Column) -> Column:
        return F.floor(-PER_OCTAVE * F.log2(weight)).cast("int")

    largest = F.col(most) if most else F.max("weight").over(Window.partitionBy(*by, key))
    return postings.withColumn("class", octaves(largest)).withColumn("level", octaves(F.col("weight"))).drop(*([most] if most else []))


def block_maxima(index: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return index.groupBy(*by, "term", "class", "level").agg(F.max("weight").alias("top"), F.count("*").alias("n"))


class Bounded(Protocol):
    """What made an index of bounds, as BoundedIndex does."""

    def texts(self, records: DataFrame) -> DataFrame:
        """Some records, given by their key, with their texts (`_texts`)."""

    def norms(self, texts: DataFrame) -> DataFrame:
        """key and norm of rows of texts()."""


class PrunedTopK:
    """The steps of one job; `store` writes a table that several steps read, and reads it back."""

    def __init__(self, vectors: DataFrame, index: DataFrame, k: int, query_key: str = "query_id", key: str = "record_id", order: str = "ord", by: Sequence[str] = (), digits: int = 9, store: Callable[[DataFrame], DataFrame] = lambda df: df, bounded: Bounded | None = None) -> None:
        """`vectors` holds unit rows of queries (by, query, term, weight), `index` the rows of impact_index() with key and order; with `bounded`, which
        made it, it also has `low` and `high`, bounds of the norm of a row's record, and weights that are parts of `low`."""
        self.k, self.query, self.key, self.order, self.by, self.digits, self.store = k, [*by, query_key], key, order, list(by), digits, store
        self.vectors, self.index, self.bounded = vectors, index, bounded
        self.few = vectors.count() <= MAX_SENT
        asked = vectors.join(block_maxima(index, by), [*by, "term"])
        self.blocks = store(asked.select(*self.query, "term", "class", "level", "n", F.col("weight").alias("w"), (F.col("weight") * F.col("top")).alias("most")))
        self.split = store(self._split())
        self.candidates = store(self._candidates())

    def _sent(self, rows: DataFrame, keys: Sequence[str], meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """meet() of rows of queries, which are measured and sent to the workers in as many parts as that takes; rows of the same keys are in one part."""
        times = -(-rows.count() // MAX_SENT)
        if times <= 1:
            return meet(F.broadcast(rows))
        part = F.pmod(F.xxhash64(*keys), F.lit(times))
        return functools.reduce(DataFrame.unionByName, [self.store(meet(F.broadcast(rows.where(part == i)))) for i in range(times)])

    def _sums(self, blocks: DataFrame) -> DataFrame:
        """What the postings of some blocks, which are stored, add to each record."""

        def meet(blocks: DataFrame) -> DataFrame:
            pairs = self.index.join(blocks, [*self.by, "term", "class", "level"])
            return pairs.groupBy(*self.query, "class", self.key).agg(F.sum(F.col("w") * F.col("weight")).alias("part"))

        return self._sent(blocks, self.query, meet)

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs of query and record with their score and what it is at least; with bounds the score is what it is at most, under `low`."""
        bounds = ("low", "high") if self.bounded else ()
        own = self.index.select(*self.by, self.key, self.order, "term", F.col("weight").alias("record_weight"), *bounds)
        vectors = F.broadcast(self.vectors) if self.few else self.vectors
        if not self.bounded:  # else the index holds asked terms alone
            own = own.join(vectors.select(*self.by, "term").distinct(), [*self.by, "term"], "left_semi")

        def meet(pairs: DataFrame) -> DataFrame:
            each = own.join(pairs, [*self.by, self.key]).join(vectors, [*self.query, "term"]).groupBy(*self.query, self.key, self.order)
            score = F.sum(F.col("weight") * F.col("record_weight"))
            if not self.bounded:
                return each.agg(F.round(score, self.digits).alias("score")).withColumn("least", F.col("score"))
            return each.agg(score.alias("score"), F.any_value("low").alias("low"), F.any_value("high").alias("high")).withColumn("least", F.col("score") * F.col("low") / F.col("high"))

        return self._sent(pairs, [*self.query, self.key], meet)

    def _first(self, df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*self.query).orderBy(*order))).where(F.col("rank") <= n)

    def first_blocks(self) -> DataFrame:
        """Each query's strongest blocks that are not too large, up to a number of postings."""
        small = self.blocks.where(F.col("n") <= FIRST_BLOCK * self.k)
        w = Window.partitionBy(*self.query).orderBy(F.desc("most"), "term", "class", "level").rowsBetween(Window.unboundedPreceding, -1)
        return small.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < FIRST_POSTINGS + TIMES_K * self.k)

    def thresholds(self) -> DataFrame:
        """`least`, a score that k records of a query reach; no row for a query without so many."""
        likely = self._first(self._sums(self.store(self.first_blocks())), FIRST_RECORDS + TIMES_K * self.k, [F.desc("part")])
        return self._reached(self._scored(self.store(likely.select(*self.query, self.key))))

    def _reached(self, scored: DataFrame) -> DataFrame:
        best = self._first(scored, self.k, [F.desc("least")])
        return best.groupBy(*self.query).agg(F.max(F.when(F.col("rank") == self.k, F.col("least"))).alias("least"))

    def _split(self) -> DataFrame:
        """Blocks with `rest`, what all blocks of the class up to this one can add to a record, and whether the block must be joined."""
        rising = Window.partitionBy(*self.query, "class").orderBy("most", "term", "level").rowsBetween(Window.unboundedPreceding, 0)
        below = F.lag("most").over(Window.partitionBy(*self.query, "class", "term").orderBy("most", "level"))
        told = self.blocks.withColumn("below", below)
        told = told.withColumn("sum", F.sum(F.col("most") - F.coalesce("below", F.lit(0.0))).over(rising))
        told = told.withColumn("length", F.sqrt(F.sum(F.when(F.col("below").isNull(), F.col("w") * F.col("w")).otherwise(0.0)).over(rising)))
        told = told.withColumn("rest", F.least("sum", "length")).join(self.thresholds(), self.query, "left")
        return told.withColumn("joined", F.coalesce(F.col("rest") >= F.col("least") - SLACK, F.lit(True))).drop("below", "sum", "length")

    def _candidates(self) -> DataFrame:
        left = F.coalesce(F.max(F.when(~F.col("joined"), F.col("rest"))), F.lit(0.0))
        rest = self.split.groupBy(*self.query, "class").agg(left.alias("rest"), F.max("least").alias("least"))
        sums = self._sums(self.split.where("joined").select(*self.query, "term", "class", "level", "w")).join(rest, [*self.query, "class"])
        return sums.where(F.col("part") + F.col("rest") >= F.coalesce("least", F.lit(0.0)) - SLACK).select(*self.query, self.key)

    def result(self) -> DataFrame:
        """query, record, order, score and rank of the k best."""
        scored = self._settled() if self.bounded else self._scored(self.candidates).drop("least")
        return self._first(scored, self.k, [F.desc("score"), F.asc(self.order)])

    def open(self) -> DataFrame:
        """Scored pairs that the bounds leave open."""
        scored = self.store(self._scored(self.candidates))
        reached = self._reached(scored).withColumnRenamed("least", "reached")
        return scored.join(F.broadcast(reached) if self.few else reached, self.query).where(F.col("score") >= F.coalesce("reached", F.lit(0.0)) - SLACK).drop("reached")

    def _settled(self) -> DataFrame:
        """Open pairs with their scores. Of records with the same text the first k in order stand for all."""
        left = self.store(self.open())
        texts = self.bounded.texts(left.select(self.key).distinct())
        told = left.join(texts.select(self.key, F.sha2(F.to_json("_texts"), 256).alias("digest")), self.key)
        alike = Window.partitionBy(*self.query, "digest").orderBy(self.order)
        kept = self.store(told.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= self.k))
        norms = self.bounded.norms(self.bounded.texts(kept.select(self.key).distinct()))
        return kept.join(norms, self.key).select(*self.query, self.key, self.order, F.round(F.col("score") * F.col("low") / F.col("norm"), self.digits).alias("score"))

    def work(self) -> DataFrame:
        """One row: pairs of postings that a join of all terms makes, and those made here: for the threshold, the candidates, and candidates scored."""
        counts = {"first": self.first_blocks().agg(F.sum("n")), "joined": self.split.where("joined").agg(F.sum("n")), "candidates": self.candidates.agg(F.count("*"))}
        return self.blocks.agg(F.sum("n").alias("every")).select("every", *(one.scalar().alias(name) for name, one in counts.items()))
