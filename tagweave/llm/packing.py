"""Harmonic packing of documents into sequences of at most `capacity` tokens.

A document is its ids and an end id. It is cut to full sequences and a rest; the rest is cut to pieces that each fill
their class well. A piece of length n is of class j = capacity // n: j of them, and no more, go into a sequence, so
each worker fills the sequences of a class by counting to j, without regard to other workers. A piece is left whole
if it wastes at most `slack` of its place; else a piece of the exact size of class j + 1 is cut off first.

What a worker cannot complete goes on, class by class, to groups of `fan` workers, of `fan` groups, and so on, which
count in the same way. What the last group of each class cannot complete - fewer than j pieces of each of the at
most 2 * sqrt(capacity) classes, however large the input - is packed first-fit, longest first.

Defined cases: a null or empty text is the end id alone; each row is packed, equal ones too; an empty table gives no
pieces; texts of any length are packed whole; pieces of equal length go by doc_id and start where workers meet. Only doc_id and text
are read, whatever other columns are called. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batches, cut, read, ship, slices

VOCABULARY, END_ID = "word_bpe_49k.json", 1
CAPACITY, SLACK, FAN = 2048, 0.02, 64

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("class", pa.int64()), ("worker", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


@lru_cache(maxsize=8192)
def rest_pieces(n: int, capacity: int, slack: float) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest of n tokens."""
    out = []
    while n > 0:
        j = capacity // n
        if capacity // j - n <= slack * (capacity // j):
            out.append((n, j))
            break
        out.append((capacity // (j + 1), j + 1))
        n -= capacity // (j + 1)
    return tuple(out)


def tokenized_pieces(docs: DataFrame, name: str = VOCABULARY, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """The pieces of all documents with their ids; those of sequences that the worker completed have their place."""
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = tokens.vocabulary_path(name, path)
        ids_of = tokens.worker_cache(f"ids of {file}", lambda: tokens.ids_of_words(file))
        worker, filled = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple]] = {}
        for b in slices(it):
            done: list[tuple] = []
            parts: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for block in tokens.word_blocks(b.column(1), tokens.splits_words(file)):
                known = ids_of(block.words)
                for k, first, to in block.spans:
                    parts[k].append(b"".join(map(known.__getitem__, block.places[first:to].tolist())))
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                ids = b"".join([*parts[k], end])
                parts[k] = []
                n = len(ids) // 4
                full, rest = divmod(n, capacity)
                at = 0
                for size, j in ((capacity, 1),) * full + rest_pieces(rest, capacity, slack):
                    mates = waiting.setdefault(j, [])
                    mates.append((doc_id, at, size, ids[4 * at : 4 * (at + size)], n, j, worker))
                    at += size
                    if len(mates) == j:
                        offset = 0
                        for m in waiting.pop(j):
                            done.append((*m, (worker << 32) + filled, offset))
                            offset += m[2]
                        filled += 1
            yield batches(dict(zip(_PIECES.names, zip(*done, strict=True) if done else [[]] * len(_PIECES), strict=True)), _PIECES)
        left = [(*m, None, None) for mates in waiting.values() for m in mates]
        yield batches(dict(zip(_PIECES.names, zip(*left, strict=True) if left else [[]] * len(_PIECES), strict=True)), _PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, class long, worker long, sequence_id long, offset long"
    )


def _counted(level: int, fan: int):
    """Fills the sequences of one class in one group of workers."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        j, group = int(pdf["class"].iloc[0]), int(pdf["worker"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "start", "length"], kind="stable", ignore_index=True)
        full = len(pdf) // j * j
        number = pdf.index // j
        offset = pdf.groupby(number)["length"].cumsum() - pdf["length"]
        # a group has fewer than fan * j waiting pieces, so fewer than fan sequences
        ids = (level << 56) + (group * (1 << 13) + j) * fan + number
        done = pdf.index < full
        return pdf.assign(sequence_id=pd.Series(ids, dtype="Int64").where(done), offset=offset.astype("Int64").where(done))

    return fill


def _first_fit(level: int, capacity: int):
    """The few pieces that no class could complete: longest first, each into the first sequence with room."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        used: list[int] = []
        place, offset = [], []
        for n in pdf["length"]:
            k = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            place.append((level << 56) + k)
            offset.append(used[k])
            used[k] += int(n)
        return pdf.assign(sequence_id=pd.Series(place, dtype="Int64"), offset=pd.Series(offset, dtype="Int64"))

    return fill


def complete(pieces: DataFrame, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """Gives a place to all pieces, those too that their worker left over. Reads `pieces` more than once: pass a written table."""
    out = pieces.where("sequence_id is not null")
    left = pieces.where("sequence_id is null")
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    level = 1
    while True:
        groups = -(-workers // fan)
        filled = left.withColumn("worker", (F.col("worker") / fan).cast("long")).groupBy("class", "worker").applyInPandas(_counted(level, fan), left.schema)
        filled = cut(filled)
        out = out.unionByName(filled.where("sequence_id is not null"))
        left = filled.where("sequence_id is null")
        workers, level = groups, level + 1
        if groups == 1:
            break
    return out.unionByName(left.groupBy(F.lit(0).alias("all")).applyInPandas(_first_fit(level, capacity), left.schema))


def pack(docs: DataFrame, **options) -> DataFrame:
    """The pieces of all documents with ids, sequence and offset."""
    return complete(cut(tokenized_pieces(docs, **options)), options.get("capacity", CAPACITY)).drop("class", "worker")


def pack_digests(docs: DataFrame, **options) -> DataFrame:
    """As pack(), with the CRC-32 of the ids in their place, so that ids are neither stored nor moved."""
    pieces = tokenized_pieces(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return complete(cut(pieces), options.get("capacity", CAPACITY)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_digests(read(spark, sf_dir, "documents"))
