"""Byte-pair encoding by speculation and verification, and decoding.

For each new word the greedy longest match proposes a row of vocabulary entries. The word's true encoding is that row
exactly if every adjacent pair is stable, that is, if merging the two entries' joined characters gives back the two.
Pairs are checked for a whole batch of words at once against a table of pairs already judged; a pair seen for the first
time is judged by exact merging. In words that fail, what exact merging makes of an unstable pair takes its place, and the
new pairs are checked in turn; a word that is not stable after ROUNDS of that is merged exactly from single characters.

Normalising and splitting text before the merges are the vocabulary file's own, with a short cut for texts of common
characters where the file splits words as that short cut does.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special tokens inside a text
become their ids; equal rows give equal rows; a table without rows gives none; long texts are encoded in parts and long
words in n log n steps; there is one encoding, so no ties; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batches, read, ship, slices

VOCABULARY = "word_bpe_49k.json"
_ASCII = re.compile(rb"[!-~]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Rounds of repairing unstable pairs before a word is merged from its characters; they change no result.
ROUNDS = 8
_ALONE = 0xFFFFFFFF


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself where that is a visible Latin-1 character, else as one beyond 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class SpeculativeBpe:
    """Encodes words of a vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix")):
            raise ValueError(f"{path} is no plain vocabulary of merges")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in (self.vocab | self.special).items()}
        size = len(self.end)
        self.last = {e[: len(e) - size]: i for e, i in self.vocab.items() if e.endswith(self.end) and len(e) > size}
        self.longest = max(map(len, self.last))
        lengths: dict[str, set[int]] = {}  # lengths of entries that start with three characters
        for entry in self.vocab:
            if len(entry) >= 3:
                lengths.setdefault(entry[:3], set()).add(len(entry))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = tokens.tokenizer(path)
        self.plain = spec["decoder"] is None
        self.quick = bool(self.end) and tokens.splits_words(path)
        #: What exact merging makes of each pair judged so far (left << 32 | right); None where the pair is stable.
        self.judged: dict[int, tuple[int, ...] | None] = {}

    def symbols(self, entry: str) -> list[str]:
        """Single characters of a vocabulary entry; the suffix belongs to the last one."""
        if self.end and entry.endswith(self.end) and len(entry) > len(self.end):
            body = entry[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(entry)

    def merged(self, parts: list[str]) -> list[str]:
        """Exact merging: the pair of least rank first, leftmost first, from a heap over a linked list."""
        rank, parts, n = self.rank.get, list(parts), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p, q) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank((p, q))) is not None]
        heapify(heap)
        gone = [False] * n
        while heap:
            _, i, p, q = heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != p or parts[j] != q:
                continue
            parts[i], gone[j], after[i] = p + q, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank((parts[k], parts[after[k]]))) is not None:
                    heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p, x in zip(parts, gone, strict=True) if not x]

    def greedy(self, word: str) -> list[int]:
        """The longest vocabulary entry at each place; only the last one may, and must, end with the suffix."""
        vocab, last, lengths, at, n, out = self.vocab.get, self.last.get, self.lengths.get, 0, len(word), []
        while at < n:
            found = last(word[at:]) if n - at <= self.longest else None
            if found is not None:
                out.append(found)
                break
            for k in lengths(word[at : at + 3], (2, 1)):
                if at + k < n and (found := vocab(word[at : at + k])) is not None:
                    break
            out.append(found)
            at += k
        return out

    def judge(self, code: int) -> tuple[int, ...] | None:
        """What merging the characters of a pair gives; None if it gives the pair back. With _ALONE on the right, of one entry."""
        pair = [self.token[code >> 32]] + ([self.token[code & _ALONE]] if code & _ALONE != _ALONE else [])
        got = self.merged([s for e in pair for s in self.symbols(e)])
        return None if got == pair else tuple(map(self.vocab.__getitem__, got))

    def unstable(self, codes: np.ndarray) -> np.ndarray:
        """Which of the pairs are unstable; pairs not known yet are judged."""
        kinds, place = np.unique(codes, return_inverse=True)
        kinds = kinds.tolist()
        if len(self.judged) > tokens.CACHE_ENTRIES:
            self.judged.clear()
        self.judged.update({c: self.judge(c) for c in kinds if c not in self.judged})
        return np.fromiter((self.judged[c] is not None for c in kinds), bool, len(kinds))[place]

    def repaired(self, row: list[int]) -> list[int]:
        """The row with each unstable pair, from left to right, as exact merging has it."""
        known, out = self.judged, row[:1]
        for i in row[1:]:
            code = out[-1] << 32 | i
            if code not in known:
                known[code] = self.judge(code)
            instead = known[code]
            if instead is None:
                out.append(i)
            else:
                out[-1:] = instead
        return out

    def failing(self, rows: list[list[int]]) -> list[int]:
        """The numbers of the rows with an unstable pair, or an entry that would not stand alone."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1] << np.uint64(32) | flat[1:])[inside]
        alone = np.flatnonzero(sizes == 1)
        single = flat[(np.cumsum(sizes) - sizes)[alone]] << np.uint64(32) | np.uint64(_ALONE)
        bad = np.zeros(len(rows), bool)
        bad[owner[1:][inside][self.unstable(pairs)]] = True
        bad[alone[self.unstable(single)]] = True
        return np.flatnonzero(bad).tolist()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        rows = [self.greedy(w) for w in words]
        bad = self.failing(rows) if rows else []
        for _ in range(ROUNDS):
            if not bad:
                return rows
            some = [self.repaired(rows[i]) for i in bad]
            for i, r in zip(bad, some, strict=True):
                rows[i] = r
            bad = [bad[k] for k in self.failing(some)]
        for i in bad:
            w = words[i]
            rows[i] = [self.vocab[p] for p in self.merged([*w[:-1], w[-1] + self.end])]
        return rows

    def pieces(self, chunk: bytes) -> list[str | int]:
        """The words of a chunk in the vocabulary's alphabet; ids of special tokens."""
        if self.quick and b"<|" not in chunk:
            if _ASCII.fullmatch(chunk):
                return _ASCII_WORDS.findall(chunk.decode().lower())
            if tokens.LETTERS_ALONE.fullmatch(chunk.decode()):
                return [chunk.decode("latin-1").translate(_ALPHABET)]
        out: list[str | int] = []
        for part in self.split_special.split(chunk.decode()) if self.split_special else [chunk.decode()]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def __call__(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each chunk its ids as bytes, and their entries joined by spaces."""
        split = [self.pieces(c) for c in chunks]
        words = list(dict.fromkeys(p for s in split for p in s if isinstance(p, str)))
        known: dict[str | int, list[int]] = dict(zip(words, self.encode_words(words), strict=True))
        known.update({i: [i] for s in split for i in s if isinstance(i, int)})
        rows = [known[s[0]] if len(s) == 1 else [i for p in s for i in known[p]] for s in split]
        return [(array("I", ids).tobytes(), self.decode(ids).encode()) for ids in rows]

    def decode(self, ids: list[int]) -> str:
        """The entries joined by spaces, unless the file has a decoder."""
        return " ".join([self.token[i] for i in ids]) if self.plain else self.library.decode(ids, skip_special_tokens=False)


def _coder(name: str, path: str | None) -> tokens.ChunkCache:
    file = tokens.vocabulary_path(name, path)
    return tokens.worker_cache(f"codes of {file}", lambda: SpeculativeBpe(file))


def encode_decode(docs: DataFrame, name: str = VOCABULARY, path: str | None = None, digests: bool = False) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the text that they decode to; or the digests of both."""
    fields = ["ids_sha256 string", "decoded_sha256 string"] if digests else ["ids binary", "decoded string"]
    names = [f.split()[0] for f in fields]
    kind = pa.string() if digests else pa.binary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), (names[0], kind), (names[1], pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = tokens.vocabulary_path(name, path)
        coder = _coder(name, path)
        for b in slices(it):
            ids: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            decoded: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for block in tokens.word_blocks(b.column(1), tokens.splits_words(file)):
                known = coder(block.words)
                of_ids, of_text = ([x[i] for x in known].__getitem__ for i in (0, 1))
                for k, first, to in block.spans:
                    places = block.places[first:to].tolist()
                    ids[k].append(b"".join(map(of_ids, places)))
                    decoded[k].append(b" ".join(filter(None, map(of_text, places))))
            left, right = [b"".join(x) for x in ids], [b" ".join(filter(None, x)) for x in decoded]
            counts = [len(x) // 4 for x in left]
            if digests:
                left, right = ([hashlib.sha256(x).hexdigest() for x in side] for side in (left, right))
            else:
                right = [x.decode() for x in right]
            yield batches({"doc_id": b.column(0).to_pylist(), "n_tokens": counts, names[0]: left, names[1]: right}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *fields]))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode_decode(read(spark, sf_dir, "documents"), digests=True)
