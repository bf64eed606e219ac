"""Token counts by a two-tier lookup on the map side.

A hash table of the most frequent chunks (a word with the space before it and what clings to it) and their token counts
is broadcast: at most `table_size` entries, from a bounded sample of documents, because it only saves work. A chunk that
is not in it is looked up in the worker's own bounded cache, and encoded by the tokenizer if it is not there either.
No chunk is ever shuffled, and each document's count is complete in one task.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal rows give equal rows; a table without rows gives none; texts
of any length are counted whole; which of equally frequent chunks the table holds changes no count. Only doc_id and text are read,
whatever other columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batches, read, ship, texts

VOCABULARY = "byte_bpe_50k.json"
#: Documents that the broadcast table is filled from, and its entries, at most.
SAMPLE_DOCS, TABLE_SIZE = 4096, 65_536
#: Characters of each of these documents that fill it; counts are over whole texts.
SAMPLE_CHARS = 16_384
LIMIT = 1024


def _lengths(path: str):
    t = tokens.tokenizer(path)
    return lambda chunks: [len(e.ids) for e in t.encode_batch_fast(list(map(tokens.spaced, chunks)), add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, name: str = VOCABULARY, path: str | None = None, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> dict[bytes, int]:
    """The frequent chunks of a bounded sample with their token counts: the first tier."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in it:
            for t in texts(b):
                found.update(tokens.by_spaces(t))
        top = [c for c, n in found.most_common(table_size) if len(c) <= tokens.CACHED_BYTES]
        lengths = _lengths(tokens.vocabulary_path(name, path))(top)
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.binary()), pa.array(lengths, pa.int32())], names=["chunk", "n"])

    n = docs.count()
    sample = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).where("text is not null").sample(fraction=min(1.0, sample_docs / max(n, 1)), seed=7).limit(sample_docs)
    return {bytes(r.chunk): r.n for r in sample.mapInArrow(run, "chunk binary, n int").collect()}


def count_tokens(docs: DataFrame, name: str = VOCABULARY, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each document."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = tokens.vocabulary_path(name, path)
        misses = tokens.worker_cache(f"lengths of {file}", lambda: _lengths(file))
        first = table.value
        for b in it:
            sizes, counts = [], []
            for t in texts(b):
                chunks = tokens.by_spaces(t)
                got = list(map(first.get, chunks))
                if None in got:
                    rest = [c for c, n in zip(chunks, got, strict=True) if n is None]
                    counts.append(sum(filter(None, got)) + sum(misses(rest)))
                else:
                    counts.append(sum(got))
                sizes.append(len(t))
            yield batches({"doc_id": b.column(0).to_pylist(), "n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return count_tokens(read(spark, sf_dir, "documents"))
