"""Exact copies by Patricia tries: each partition's trie holds the full bytes of its texts, and a terminal node its owner.

Two texts are equal if their bytes are, after every run of `[\\x20\\x09-\\x0D]` has become one space. Each input task inserts its
texts into a trie, so that copies meet before anything is moved; what leaves is one row for each different text of a task, with
the doc_ids that have it. These rows are dealt by length and digest, and each partition's trie finds the smallest doc_id of each
text from the full bytes. A trie that outgrows its bound gives up its largest subtree: the rows of that subtree leave as parts,
and a last aggregation by length and digest adds up parts. A text that a third of all rows share is thus one row a task, and its
doc_ids are never gathered: lists of one task each are joined with the owner and unfolded.

Defined cases: a null text counts as empty, and empty texts are copies of each other; a text of white space alone is one space;
texts of any length are compared whole; of rows that share the smallest doc_id one stays; rows without doc_id are documents like
others, and stay only where no copy has a doc_id, one of them, with keep_id null; a table without rows gives none. Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, read, ship, slices, texts

#: Bytes of texts, and rows, that a trie holds before its largest subtree leaves it.
TRIE_BYTES, TRIE_ROWS = 48 << 20, 100_000
#: Bytes of texts in a batch of rows that leaves a task.
BATCH_BYTES = 4 << 20

PIECES = "n_bytes long, text_sha256 string, text binary, ids array<long>, batch string"
PARTS = "n_bytes long, text_sha256 string, least long, batch string, n long"
_PIECES = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())), ("batch", pa.string())])
_PARTS = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("least", pa.int64()), ("batch", pa.string()), ("n", pa.int64())])


def normalized(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    if not text:
        return text
    words = b" ".join(text.split())
    if not words:
        return b" "
    return (b" " if text[:1].isspace() else b"") + words + (b" " if text[-1:].isspace() else b"")


class Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes) -> None:
        self.label, self.kids, self.value = label, {}, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of `label` stand in `key` from `at` on."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(label[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie over byte strings; `limit` bytes and `rows` insertions at most, else subtrees leave through `full()`."""

    def __init__(self, limit: int = TRIE_BYTES, rows: int = TRIE_ROWS) -> None:
        self.root, self.limit, self.rows = Node(b""), limit, rows
        self.sizes: Counter[int] = Counter()
        self.counts: Counter[int] = Counter()
        self.bytes = self.n = 0

    def node(self, key: bytes) -> Node:
        """The node where `key` ends; made if it is not there."""
        node, at, new = self.root, 0, 0
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                child = node.kids[key[at]] = Node(key[at:])
                new = len(child.label)
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _shared(label, key, at)
            middle = node.kids[key[at]] = Node(label[:k])
            child.label = label[k:]
            middle.kids[child.label[0]] = child
            node, at = middle, at + k
        first = key[0] if key else -1
        self.n += 1
        self.bytes += new
        self.sizes[first] += new
        self.counts[first] += 1
        return node

    def full(self) -> Iterator[tuple[bytes, object]]:
        """While the trie is over its bound, the terminals of its largest subtree, which goes."""
        while self.bytes > self.limit or self.n > self.rows:
            yield from self.leave((self.sizes if self.bytes > self.limit else self.counts).most_common(1)[0][0])

    def leave(self, first: int) -> Iterator[tuple[bytes, object]]:
        """The terminals below the root's child of a first byte (-1: the empty key), as (key, value); the child goes."""
        if first < 0:
            top, self.root.value = Node(b""), self.root.value
            top.value, self.root.value = self.root.value, None
        else:
            top = self.root.kids.pop(first)
        self.bytes -= self.sizes.pop(first, 0)
        self.n -= self.counts.pop(first, 0)
        stack = [(top, b"")]
        while stack:
            node, above = stack.pop()
            key = above + node.label if above else node.label
            if node.value is not None:
                yield key, node.value
            stack.extend((kid, key) for kid in node.kids.values())

    def rest(self) -> Iterator[tuple[bytes, object]]:
        for first in list(self.counts):
            yield from self.leave(first)


class _Out:
    """Rows that are gathered into batches of bounded size; `row` gives a terminal's columns and how many bytes they have."""

    def __init__(self, schema: pa.Schema, row: Callable[[bytes, object], tuple]) -> None:
        self.schema, self.row, self.columns, self.bytes = schema, row, {f.name: [] for f in schema}, 0

    def put(self, terminals: Iterator[tuple[bytes, object]], last: bool = False) -> Iterator[pa.RecordBatch]:
        for key, value in terminals:
            row, size = self.row(key, value)
            for column, x in zip(self.columns.values(), row, strict=True):
                column.append(x)
            self.bytes += size + 64
            if self.bytes > BATCH_BYTES:
                yield self.flush()
        if last and self.bytes:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        out = batches(self.columns, self.schema)
        self.columns, self.bytes = {f.name: [] for f in self.schema}, 0
        return out


def _pieces(limit: int, rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, ids: list) -> tuple:
            ids.sort(key=lambda x: (x is None, x or 0))
            return (len(key), hashlib.sha256(key).hexdigest(), key, ids, uuid.uuid4().hex), len(key) + 8 * len(ids)

        trie, out = Trie(limit, rows), _Out(_PIECES, row)
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                end = trie.node(normalized(text))
                if end.value is None:
                    end.value = []
                end.value.append(doc_id)
                yield from out.put(trie.full())
        yield from out.put(trie.rest(), True)

    return run


def _parts(limit: int, rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, owner: list) -> tuple:
            return (len(key), owner[0], owner[1][1] if owner[1][0] == 0 else None, owner[1][2], owner[2]), 64

        trie, out = Trie(limit, rows), _Out(_PARTS, row)
        for b in it:
            digests, keys, least, batch, n = (b.column(i).to_pylist() for i in range(1, 6))
            for digest, key, i, of, count in zip(digests, keys, least, batch, n, strict=True):
                end, mine = trie.node(key), (i is None, i or 0, of)
                if end.value is None:
                    end.value = [digest, mine, count]
                elif end.value[0] != digest:
                    raise ValueError("one text has two digests")
                else:
                    end.value[1:] = min(end.value[1], mine), end.value[2] + count
                yield from out.put(trie.full())
        yield from out.put(trie.rest(), True)

    return run


def copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept and text_sha256."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = cut(slim.mapInArrow(_pieces(trie_bytes, trie_rows), PIECES))
    each = pieces.select("n_bytes", "text_sha256", "text", F.array_min("ids").alias("least"), "batch", F.size("ids").cast("long").alias("n"))
    parts = each.repartition("n_bytes", "text_sha256").mapInArrow(_parts(trie_bytes, trie_rows), PARTS)
    owner = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "batch")).alias("owner")
    owners = parts.groupBy("n_bytes", "text_sha256").agg(owner, F.sum("n").alias("group_size"))
    joined = pieces.select("n_bytes", "text_sha256", "ids", "batch").join(owners, ["n_bytes", "text_sha256"])
    rows = joined.select("text_sha256", "owner", "group_size", "batch", F.posexplode("ids").alias("pos", "doc_id"))
    kept = (F.col("batch") == F.col("owner.batch")) & (F.col("pos") == 0)
    return rows.select("doc_id", F.col("owner.least").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return copies(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
    select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t"""
