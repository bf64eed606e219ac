"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of adjacent words are hashed to `buckets` buckets. The raw model counts the buckets over all documents,
the target model over those of a bounded sample of labels (`label_rows` rows, least hash first) that are good. A document's
log importance weight is the sum over its n-grams of the log ratio of the two models. Adding standard Gumbel noise, which
depends on doc_id alone, to log weight / temperature and taking the k largest sums draws k documents without replacement
in proportion to their weights. k is the number of documents whose log weight is at least the bound that separates good
from bad labels best (greatest sum of the two classes' shares on the right side, good ones counting GOOD_WEIGHT times).

Defined cases: a null or empty text has log weight 0; documents that tie at the cut are all kept; equal rows get equal
rows; where no good label is known both models are the same and all documents are kept; where no bad one is known
the bound is the least log weight of the good ones; a table without rows gives none; texts of any length are counted and weighed
whole. Only doc_id and text, and doc_id and quality of labels, are read, and keep_good() hands all other columns on.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batches, cut, drop, read, ship, texts, unused

BUCKETS, LABEL_ROWS, TEMPERATURE, SEED = 10_000, 20_000, 1.0, 20_240_229
#: N-grams of raw text that are added to the target text, so that a small target sample says little about rare buckets.
PRIOR = 100_000.0
#: Weight of keeping good documents against rejecting bad ones where the bound is set.
GOOD_WEIGHT = 3.0
#: The exact cut is looked for among at most so many values at last.
LAST_VALUES = 10_000

_WORD = re.compile(r"\w+|[^\w\s]+")


def _hashed(chunks: list[bytes]) -> list[bytes]:
    return [array("Q", [xxhash.xxh64_intdigest(w.encode()) for w in _WORD.findall(c.decode())]).tobytes() for c in chunks]


def buckets_of(raw: bytes, buckets: int) -> np.ndarray:
    """The buckets of all words and of all pairs of adjacent words."""
    cache = tokens.worker_cache("quality words", lambda: _hashed, tokens.FEW_ENTRIES)
    h = np.frombuffer(b"".join(cache(raw.split())), np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pair ^= pair >> np.uint64(32)
    return (np.concatenate([h, pair * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(8)]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw and target counts over all rows of `docs` (text, target boolean)."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in it:
            for t, good in zip(texts(b), b.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets_of(t, buckets), minlength=buckets)
                raw += n
                if good:
                    target += n
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(target[seen])], schema=schema)

    found = docs.select(F.col("text").cast("string").alias("text"), "target").mapInArrow(run, "bucket int, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability for each bucket; zeros if there is no target text."""
    raw, target = np.full(buckets, 0.5), np.zeros(buckets)
    for r in counts.collect():  # at most one row a bucket
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if not target.any():
        return np.zeros(buckets)
    raw /= raw.sum()
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR)) - np.log(raw)


def _weights(ratios: np.ndarray, raws: list[bytes]) -> list[float]:
    return [float(ratios[buckets_of(t, len(ratios))].sum()) for t in raws]


def gumbel(seed: int = SEED) -> Column:
    """A row's noise: drawn by doc_id, or by the text where there is no doc_id, so that only equal texts share a draw there."""
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(seed))
    u = (F.pmod(F.when(F.col("doc_id").isNull(), own).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def label_sample(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """One quality for each of at most `rows` labelled documents; the lower one where labels disagree."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def separating_bound(good: list[float], bad: list[float]) -> float:
    """The bound with the greatest weighted sum of shares of good ones at or above and bad ones below it."""
    if not good:
        return -math.inf
    if not bad:
        return min(good)
    g, b = np.sort(good), np.sort(bad)
    at = np.unique(g)
    gain = GOOD_WEIGHT * (len(g) - np.searchsorted(g, at)) / len(g) + np.searchsorted(b, at) / len(b)
    k = int(np.argmax(gain))
    below = b[np.searchsorted(b, at[k]) - 1] if np.searchsorted(b, at[k]) else at[k]
    return float((at[k] + below) / 2)


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of the column `key`, exactly: counts over ever narrower ranges, then a sort of the few values left."""
    lo, hi, n = values.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while True:
        inside = values.where((F.col("key") >= lo) & (F.col("key") <= hi))
        if n <= LAST_VALUES or hi <= lo or (hi - lo) / bins == 0:
            rows = inside.groupBy("key").count().orderBy(F.desc("key")).limit(2 * LAST_VALUES).collect()
            for r in rows:
                k -= r["count"]
                if k <= 0:
                    return r.key
            return lo
        width = (hi - lo) / bins
        slot = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int").alias("slot")
        counts = {r.slot: r for r in inside.groupBy(slot).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for s in sorted(counts, reverse=True):
            if k <= counts[s].n:
                lo, hi, n = counts[s].lo, counts[s].hi, counts[s].n
                break
            k -= counts[s].n


class Resampler:
    """What the passes over all documents have found: the models' log ratios, the bound, k, and the cut that keeps k."""

    def __init__(self, docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS, temperature: float = TEMPERATURE, seed: int = SEED):
        spark = docs.sparkSession
        self.temperature, self.seed = temperature, seed
        sample = cut(label_sample(labels, label_rows))
        known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left")
        ratios = log_ratios(bucket_counts(known.select("text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("target")), buckets), buckets)
        self.shared = spark.sparkContext.broadcast(ratios)
        self.scores = cut(self.weigh(docs))
        labelled = self.scores.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.first("quality").alias("quality"), F.min("log_weight").alias("w")).collect()
        self.bound = separating_bound([r.w for r in labelled if r.quality == 1], [r.w for r in labelled if r.quality != 1])
        self.k = self.scores.where(F.col("log_weight") >= self.bound).count()
        self.least_key = kth_largest(self.scores, self.k)
        drop(sample)

    def weigh(self, docs: DataFrame) -> DataFrame:
        """doc_id, log_weight and key of each row."""
        schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("noise", pa.float64())])
        shared = self.shared

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield batches({"doc_id": b.column(0).to_pylist(), "log_weight": _weights(shared.value, texts(b)), "noise": b.column(2).to_pylist()}, schema)

        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), gumbel(self.seed).alias("noise")).mapInArrow(run, "doc_id long, log_weight double, noise double")
        return out.select("doc_id", "log_weight", (F.col("log_weight") / self.temperature + F.col("noise")).alias("key"))

    def decisions(self) -> DataFrame:
        return self.scores.withColumn("kept", F.col("key") >= self.least_key)

    def keep_good(self, docs: DataFrame) -> DataFrame:
        """The rows of `docs` that are drawn; same columns."""
        schema = docs.schema
        names = schema.fieldNames()
        key = unused(docs, "key")
        i = names.index("text")
        shared = self.shared

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield b.append_column(key, pa.array(_weights(shared.value, texts(b.select([i]))), pa.float64()))

        weighed = docs.mapInArrow(run, docs.withColumn(key, F.lit(0.0)).schema)
        return weighed.where(F.col(key) / self.temperature + gumbel(self.seed) >= self.least_key).select(*names)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return Resampler(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).decisions()
