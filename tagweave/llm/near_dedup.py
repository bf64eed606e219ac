"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is its row of shingles: each five adjacent words (lower case, `\\w+`), labelled with how often the same five
stood before, so that all labelled shingles of a document differ. Each of `repeats` sketches samples the `sample`
labelled shingles of least hash, and keeps them in text order; documents with an equal sketch are candidates.

The similarity of two documents is L / (n + m - L), where n and m count their shingles and L is the length of the longest
common subsequence of labelled shingles: the Jaccard similarity of shingles that stand in the same order. At a
threshold t only shingles whose places differ by at most max(n, m) - ceil(t (n + m) / (1 + t)) can take part, so alignment
within that band is exact.

Documents with equal words are one node. Each bucket of candidates is first compared along a star, every node with the one
of the bucket's least doc_id. A bucket whose nodes are in several components after that is open. Comparing all pairs of an
open bucket would grow with its square, and most of them cannot reach the threshold: two nodes that can share one of
their rarest shingles (the prefix filter, which is exact). So of all pairs of nodes of open buckets in different components those
with a common prefix shingle are verified: first along a star for each shingle, which joins nearly all components that belong
together, then every pair that is left. Each node also has a bitmap of its shingles: a bit that one has and the other lacks is a
shingle missing there, and a pair with more of them than the threshold allows is not made. So of texts that share a frame, and
with it many rare shingles, only pairs near the threshold are. A large group of near copies is thus not compared pair by pair,
and no link between two components is left out.

Defined cases: rows of equal words are one class; a text that is null or has no word is compared with nothing and is a class of
its own; rows without doc_id are compared like others, and where no member of a class has a doc_id its class_id is null; rows that
share a doc_id but not a text are compared as different documents, only the names of their classes are equal; a text of
fewer than `shingle` words is one shingle; texts of any length are aligned whole; of equally good heads of a bucket any one serves, since
the classes do not depend on it; a table without rows gives none. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import batches, cut, drop, read, ship, slices, texts, unused
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
SAMPLE, REPEATS = 3, 20
#: Longs of a node's bitmap.
MAP = 8
#: Lengths of one class differ by at most this factor.
CLASS_WIDTH = 1.02

_WORD = re.compile(r"\w+")
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CELLS = 1 << 21  # shingles times repeats that are hashed at once


def _hashed(chunks: list[bytes]) -> list[bytes]:
    return [array("Q", [xxhash.xxh64_intdigest(w.encode()) for w in _WORD.findall(c.decode().lower())]).tobytes() for c in chunks]


def word_hashes(raw: bytes) -> np.ndarray:
    cache = tokens.worker_cache("shingle words", lambda: _hashed, tokens.FEW_ENTRIES)
    return np.frombuffer(b"".join(cache(raw.split())), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K2
    return x ^ (x >> np.uint64(29))


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each shingle with its occurrence number; a text of fewer words is one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = _mix(h * _K1 + words[i : n - width + 1 + i])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(h + nth * _K3)


def sketches(labelled: np.ndarray, sample: int = SAMPLE, repeats: int = REPEATS) -> list[int]:
    """Order MinHash: for each repeat the hash of the sampled labelled shingles in text order."""
    n = len(labelled)
    if not n:
        return []
    seeds = _mix(np.arange(1, repeats + 1, dtype=np.uint64) * _K3)
    keep = min(sample, n)
    step = max(1, _CELLS // n)
    out = []
    for a in range(0, repeats, step):
        h = (labelled[None, :] ^ seeds[a : a + step, None]) * _K1
        h ^= h >> np.uint64(32)
        h *= _K2
        least = np.argpartition(h, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(h), 1))
        ordered = labelled[np.sort(least, axis=1)]
        key = seeds[a : a + step].copy()
        for i in range(keep):
            key = _mix(key * _K1 + ordered[:, i])
        out += key.view(np.int64).tolist()
    return out


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n + m - L) of two rows of labelled shingles by alignment within the band; 0 where it is below `least`."""
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0
    need = ceil(least * (n + m) / (1 + least) - 1e-9)
    if min(n, m) < need:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = np.abs(i - j) <= max(n, m) - need
    i, j = i[band], j[band]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        long = len(j)
    else:
        tails: list[int] = []
        for p in j.tolist():
            k = bisect_left(tails, p)
            if k == len(tails):
                tails.append(p)
            else:
                tails[k] = p
        long = len(tails)
    return long / (n + m - long) if long >= need else 0.0


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that rows of equal doc_id and text share; null and empty text count as equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def signatures(docs: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, row_key, the digest of the document's words, its number of shingles and its sketches; no digest without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("digest", pa.binary()), ("n", pa.int32()), ("sketches", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            digests, sizes, found = [], [], []
            for t in texts(b):
                w = word_hashes(t)
                s = labelled_shingles(w, shingle)
                digests.append(xxhash.xxh128_digest(w.tobytes()) if len(w) else None)
                sizes.append(len(s))
                found.append(sketches(s, sample, repeats))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), *(pa.array(x, f.type) for x, f in zip((digests, sizes, found), list(schema)[2:], strict=True))], schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, row_key binary, digest binary, n int, sketches array<long>")


def verified(pairs: DataFrame, candidates: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Those of the pairs (a, b) whose texts in `candidates` (node, text) are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in it:
            a, b = [], []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                if s != last:
                    last, left = s, labelled_shingles(word_hashes(s), shingle)
                if similarity(left, labelled_shingles(word_hashes(t), shingle), least) > 0:
                    a.append(x)
                    b.append(y)
            yield batches({"a": a, "b": b}, schema)

    of_b = candidates.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    of_a = candidates.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def bitmap(labelled: np.ndarray) -> list[int]:
    """MAP longs with a bit for each shingle; different shingles may share one."""
    bits = np.zeros(64 * MAP, np.uint8)
    bits[(labelled >> np.uint64(17)) % np.uint64(64 * MAP)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def prefix_shingles(open_: DataFrame, candidates: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """node, n, token and place for the first shingles of the open nodes (node, component); and their bitmaps (node, m0, m1, ...).

    Shingles are ordered by how many open nodes have them, rare ones first. Two nodes of n and m shingles that share k =
    ceil(t (n + m) / (1 + t)) of them share one of the first n - k + 1 of the one and the first m - k + 1 of the other.
    """
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("map", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [labelled_shingles(word_hashes(t), shingle) for t in texts(b)]
            yield batches({"node": b.column(0).to_pylist(), "component": b.column(1).to_pylist(), "n": list(map(len, rows)), "tokens": [r.view(np.int64) for r in rows], "map": list(map(bitmap, rows))}, schema)

    shingles = cut(candidates.join(open_, "node").select("node", "component", "text").mapInArrow(run, "node long, component long, n int, tokens array<long>, map array<long>"))
    each = shingles.select("node", "component", "n", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    # shingles of one node alone come first in its order and match nothing: their number is enough
    known = each.join(common, "token")
    mine = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "token"))
    # a shingle that one component alone has matches nothing either, but keeps its place
    inside = (F.col("lo") < F.col("hi")) & (F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    out = cut(known.withColumn("place", place).where(inside).select("node", "n", "token", "place"))
    maps = cut(shingles.select("node", *(F.get("map", F.lit(i)).alias(f"m{i}") for i in range(MAP))))
    drop(shingles)
    return out, maps


def _mapped(rows: DataFrame, maps: DataFrame, side: str) -> DataFrame:
    """Rows of `side` (x or y) with the node's bitmap."""
    return rows.join(maps.select(F.col("node").alias(side), *(F.col(f"m{i}").alias(f"m{i}_{side}") for i in range(MAP))), side)


def _missing(a: str, b: str) -> Column:
    """At least so many shingles of the one are not in the other."""
    out = F.lit(0)
    for i in range(MAP):
        out = out + F.bit_count(F.col(f"m{i}_{a}").bitwiseAND(F.bitwise_not(F.col(f"m{i}_{b}"))))
    return out


def _needed(n: Column, m: Column, least: float) -> Column:
    return F.ceil(least / (1 + least) * (n + m) - 1e-9)


def _can_reach(least: float) -> Column:
    """Whether nodes x and y, of n_x and n_y shingles, that meet at places p_x and p_y can share as many as they need, by their places and their bitmaps."""
    k = _needed(F.col("n_x"), F.col("n_y"), least)
    prefixes = (F.col("p_x") <= F.col("n_x") - k + 1) & (F.col("p_y") <= F.col("n_y") - k + 1)
    # at their first common shingle a pair must still be able to share as many as it needs
    places = (F.least("n_x", "n_y") >= k) & prefixes & (F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) + 1 >= k)
    return places & (_missing("x", "y") <= F.col("n_x") - k) & (_missing("y", "x") <= F.col("n_y") - k)


def prefix_star(first: DataFrame, maps: DataFrame, where: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of one node for each shingle with all others that have it and are in another component."""
    rows = first.join(where, "node")
    hub = F.min_by("node", F.xxhash64("node", "token")).alias("y")
    hubs = rows.groupBy("token").agg(hub, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "y")
    of_y = rows.select("token", F.col("node").alias("y"), F.col("component").alias("of_y"), F.col("n").alias("n_y"), F.col("place").alias("p_y"))
    hubs = _mapped(hubs.join(of_y, ["token", "y"]), maps, "y")
    rays = _mapped(rows.withColumnsRenamed({"node": "x", "n": "n_x", "place": "p_x"}), maps, "x").join(hubs, "token").where((F.col("component") != F.col("of_y")) & _can_reach(least))
    return rays.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def prefix_join(first: DataFrame, maps: DataFrame, where: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """All pairs (a, b) of nodes of different components that can be similar enough.

    The longer node asks for each class of lengths that the shorter one can have, with as long a prefix as that class needs. A
    node that is not similar to the text that a large group has in common differs from it in more shingles than its prefix is
    long, so it meets only nodes that share its own rare ones. Of the nodes with a shingle those of the component that most of
    them are in are never joined with each other.
    """

    def length_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / log(CLASS_WIDTH)).cast("int")

    several = first.join(where, "node").groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = first.join(where, "node").join(several, "token")
    given = rows.where(F.col("place") <= F.col("n") - _needed(F.col("n"), F.col("n"), least) + 1).withColumn("class", length_class(F.col("n")))
    kinds = F.sequence(length_class(F.ceil(least * F.col("n") - 1e-9)), length_class(F.col("n")))
    shortest = F.floor(F.pow(F.lit(CLASS_WIDTH), F.col("class")) - 1e-9)
    asked = rows.withColumn("class", F.explode(kinds)).where(F.col("place") <= F.col("n") - _needed(F.col("n"), shortest, least) + 1)
    sides = cut(given.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))))
    counts = sides.groupBy("token", "class", "component").agg(F.count("*").alias("k"))
    most = counts.groupBy("token", "class").agg(F.max_by("component", "k").alias("most"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    live = cut(sides.join(most, ["token", "class"]))
    out = None
    for asks in (False, True):
        few = live.where((F.col("component") != F.col("most")) & (F.col("asks") == asks)).select("token", "class", F.col("node").alias("x"), F.col("component").alias("of_x"), F.col("n").alias("n_x"), F.col("place").alias("p_x"))
        all_ = live.where(F.col("asks") != asks).select("token", "class", F.col("node").alias("y"), F.col("component").alias("of_y"), F.col("n").alias("n_y"), F.col("place").alias("p_y"))
        few, all_ = _mapped(few, maps, "x"), _mapped(all_, maps, "y")
        fits = (F.col("n_x") >= F.col("n_y")) if asks else (F.col("n_y") >= F.col("n_x"))
        found = few.join(all_, ["token", "class"]).where(fits & _can_reach(least) & (F.col("of_x") != F.col("of_y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        out = found if out is None else out.unionByName(found)
    out = cut(out.distinct())
    drop(sides, live)
    return out


def joined(where: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) of all nodes of `where` after further links (a, b) between them."""
    to = [where.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
    between = cut(links.join(to[0], "a").join(to[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("instead"))
    return cut(where.join(moved, "component", "left").select("node", F.coalesce("instead", "component").alias("component")))


def grouped(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, sample: int = SAMPLE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """doc_id, row_key and digest of each row; and for each digest its component, and the component's least doc_id as class_id.

    A component is the documents that links of similarity `least` or more join. Rows without words have no digest.
    """
    marks = cut(signatures(docs, shingle, sample, repeats))
    rows = marks.select("doc_id", "row_key", "digest")
    # nodes are numbered in the order of their least doc_id; the numbers hold from here on, because the table is written
    different = marks.where("digest is not null").groupBy("digest", "n", "sketches").agg(F.min("doc_id").alias("label"))
    nodes = cut(different.orderBy(F.asc_nulls_last("label"), "digest").withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select(F.explode("sketches").alias("bucket"), "node")
    heads = places.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head")
    members = cut(places.join(heads, "bucket").select("bucket", "node", "head"))

    wanted = nodes.join(members.select("node").distinct(), "node").select("digest", "node", "label", "n")
    keys = rows.join(wanted, "digest").where(F.col("doc_id").eqNullSafe(F.col("label"))).groupBy("node").agg(F.min("row_key").alias("key"))
    plain = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    candidates = cut(plain.join(keys, "key").groupBy("key", "node").agg(F.first("text").alias("text")).drop("key"))

    lengths = wanted.select("node", "n")
    rays = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    rays = rays.join(lengths.toDF("a", "n_a"), "a").join(lengths.toDF("b", "n_b"), "b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    star = cut(rays.select("a", "b"))
    links = cut(verified(star, candidates, least, shingle))
    found = components(links)
    where = cut(candidates.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    # what the stars leave open: buckets whose nodes are in several components
    placed = members.join(where, "node").select("bucket", "node", "component")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_ = cut(placed.join(split, "bucket", "left_semi").select("node", "component").distinct())
    first, maps = prefix_shingles(open_, candidates, least, shingle)
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for pairs_of in (prefix_star, prefix_join):
        pairs = cut(pairs_of(first, maps, where, least).join(tried, ["a", "b"], "left_anti"))
        before, where = where, joined(where, verified(pairs, candidates, least, shingle))
        drop(before)
        tried = tried.unionByName(pairs)

    named = nodes.join(where, "node", "left").select("digest", "label", F.coalesce("component", "node").alias("component"))
    classes_ = named.groupBy("component").agg(F.min("label").alias("class_id"))
    out = cut(named.drop("label").join(classes_, "component"))
    drop(candidates, members, nodes, where, first, maps, open_, links, star)
    return rows, out


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id of each row: the least doc_id of the documents that links join, or its own where it has no words."""
    rows, found = grouped(docs, **options)
    out = rows.select("doc_id", "digest").join(found.select("digest", "class_id"), "digest", "left")
    return out.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, and all rows without words; same columns.

    It is a row of the least doc_id; of different texts with that doc_id the one of least row_key; of rows that agree in both any one.
    """
    rows, found = grouped(docs, **options)
    least = rows.join(found, "digest").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    counts = least.groupBy("component", "row_key").agg(F.count("*").alias("rows"))
    chosen = counts.groupBy("component").agg(F.min(F.struct("row_key", "rows")).alias("it")).select("it.row_key", F.col("it.rows") > 1)
    all_ = rows.where("digest is null").select("row_key", F.lit(False)).distinct()
    key, again = unused(docs, "row_key"), unused(docs, "again")
    kept = cut(chosen.toDF(key, again).unionByName(all_.toDF(key, again)))
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    once = keyed.join(kept.where(~F.col(again)).select(key), key, "left_semi")
    one = keyed.join(kept.where(again).select(key), key, "left_semi").dropDuplicates([key])
    return once.unionByName(one).select(*docs.columns)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return classes(read(spark, sf_dir, "documents"))
