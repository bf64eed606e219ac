"""Tokenizers of public vocabulary files, applied through caches of independent chunks of text.

A chunk is a piece of a text whose tokens do not depend on what stands around it, so a text's tokens are those of its
chunks in order. Each Python worker keeps one bounded cache, which tasks that follow find filled.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Entries that a worker's cache holds at most, both generations together, but for one call's (about 150 bytes each).
CACHE_ENTRIES = 300_000
#: The same for what is cheap to compute again.
FEW_ENTRIES = 150_000
#: A chunk longer than this is encoded, but not kept.
CACHED_BYTES = 64

#: First bytes of characters that no tokenizer takes for white space: print of ASCII, and lead bytes whose blocks have none.
_SOLID = rb"[!-~\xc3-\xe0\xe4-\xf4]"
_BEFORE_WORD = re.compile(rb"(?= " + _SOLID + rb")")
_UNSURE = re.compile(rb" (?!" + _SOLID + rb")")
#: Marks the first chunk of a text, which has no space before it.
FIRST = b"\x00"
_OPENED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file without truncation and padding, opened once a worker."""
    if path not in _OPENED:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _OPENED[path] = t
    return _OPENED[path]


def vocabulary_path(name: str, path: str | None = None) -> str:
    """Where a vocabulary file lies on the machine that asks."""
    return path or public_tokenizers.path(name)


def by_white_space(raw: bytes) -> list[bytes]:
    """Chunks for tokenizers that drop white space and never join what stands on both sides of it."""
    return raw.split()


#: Texts of these characters alone, without special tokens, are split by _SPLIT as by the vocabulary file: they are in
#: normal form C, and what is neither letter nor digit nor white space among them is a mark to it.
_NOT_PLAIN = r"[^\t\n\r -~À-ÖØ-öø-ÿ“”‘’–—…«»¿¡€]|<\|"
_LETTERS = "a-zß-öø-ÿ"
_SPLIT = rf"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9{_LETTERS}]+)"
#: Words of letters alone, in lower case.
LETTERS_ALONE = re.compile(f"[{_LETTERS}]+")
#: How a vocabulary file must normalise and split for that.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text that are split at once.
BLOCK = 8 << 20


@lru_cache
def splits_words(path: str) -> bool:
    """Whether word_blocks() may split texts to lower-case words for this vocabulary file; else it leaves them whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return spec["normalizer"] == _NORMALIZER and first.get("pattern") == {"Regex": _WORDS}


@dataclass
class Block:
    """Texts as places of words: text k's words, or those of a part of it, are words[p] for p in places[first:end]."""

    words: list[bytes]
    places: np.ndarray
    spans: list[tuple[int, int, int]]  # k, first, end


def _split(owners: list[int], column: pa.Array) -> Block:
    spaced = pc.replace_substring_regex(pc.utf8_lower(column), _SPLIT, r" \1 ")
    rows = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    coded = rows.flatten().dictionary_encode()
    ends = rows.offsets.to_pylist()
    return Block(coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), list(zip(owners, ends, ends[1:], strict=False)))


def word_blocks(column: pa.Array, words: bool = True) -> Iterator[Block]:
    """The words of a column of texts in blocks of bounded size; long texts are cut at spaces, so parts of a text come in order.

    For texts with rare characters or special tokens the pieces between ASCII white space are the words; without `words`, for
    vocabularies that may join what white space divides, a whole text is one. Null texts and, with `words`, texts of white space have none.
    """
    column = column.cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(column, _NOT_PLAIN).to_pylist() if words else [True] * len(column)
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(column) if words else column), 0).to_pylist()
    group: list[int] = []
    size = 0
    for k, n in enumerate(pc.binary_length(column).to_pylist()):
        if blank[k]:
            continue
        if odd[k]:
            raw = column[k].as_py().encode()
            chunks = by_white_space(raw) if words else [raw]
            place = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
            yield Block(list(place), np.array([place[c] for c in chunks], np.int64), [(k, 0, len(chunks))])
            continue
        if n > BLOCK:
            text, at = column[k].as_py(), 0
            while at < len(text):
                to = text.find(" ", at + BLOCK)
                part = text[at : to if to >= 0 else len(text)]
                at += len(part) or 1
                if not part.isspace():
                    yield _split([k], pa.array([part]))
            continue
        if group and size + n > BLOCK:
            yield _split(group, column.take(pa.array(group)))
            group, size = [], 0
        group.append(k)
        size += n
    if group:
        yield _split(group, column.take(pa.array(group)))


def by_spaces(raw: bytes) -> list[bytes]:
    """Chunks for byte-level tokenizers, whose words carry the space before them: where a space comes before a solid
    character, a word starts with it. That space is left out of the chunk; FIRST marks the one chunk that has none.
    """
    if not raw:
        return []
    if _UNSURE.search(raw):
        first, *rest = _BEFORE_WORD.split(raw)
        return [FIRST + first, *(c[1:] for c in rest)]
    out = raw.split(b" ")
    out[0] = FIRST + out[0]
    return out


def spaced(chunk: bytes) -> str:
    """The text that a chunk of by_spaces() stands for."""
    return (chunk[1:] if chunk.startswith(FIRST) else b" " + chunk).decode()


class ChunkCache:
    """A bounded map from chunks to what `compute` gives for a list of them; values are never None.

    It has two generations: what is asked for while the younger one fills is kept, the rest goes with the older one.
    """

    def __init__(self, compute: Callable[[list[bytes]], list], entries: int | None = None):
        self.compute, self.entries = compute, entries or CACHE_ENTRIES
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def __call__(self, chunks: list[bytes]) -> list:
        out = list(map(self.young.get, chunks))
        if None not in out:
            return out
        missing = list({c for c, v in zip(chunks, out, strict=True) if v is None})
        found = {c: v for c, v in zip(missing, map(self.old.get, missing), strict=True) if v is not None}
        new = [c for c in missing if c not in found] if found else missing
        found.update(zip(new, self.compute(new), strict=True))
        out = [found[c] if v is None else v for c, v in zip(chunks, out, strict=True)]
        for c in [c for c in new if len(c) > CACHED_BYTES]:
            del found[c]
        if len(self.young) + len(found) > self.entries // 2:
            self.old, self.young = self.young, {}
        self.young.update(found)
        return out


_ACTIVE: dict[str, ChunkCache] = {}


def worker_cache(use: str, make: Callable[[], Callable[[list[bytes]], list]], entries: int | None = None) -> ChunkCache:
    """The worker's cache for one use. A worker that goes on to another use drops the cache it had, so it holds one at most."""
    if use not in _ACTIVE:
        _ACTIVE.clear()
        _ACTIVE[use] = ChunkCache(make(), entries)
    return _ACTIVE[use]


def ids_of_words(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """The ids of white-space chunks as little-endian unsigned 32-bit integers."""
    t = tokenizer(path)
    suffix = getattr(t.model, "end_of_word_suffix", None) if splits_words(path) else None
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for w, i in t.get_vocab(False).items() if suffix and w.endswith(suffix)]] = True

    def rows(strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(strings, add_special_tokens=False)]

    def compute(chunks: list[bytes]) -> list[bytes]:
        strings = [c.decode() for c in chunks]
        if not suffix:
            return rows(strings)
        found: dict[str, bytes] = {}
        # words of letters alone go many at a time: each ends where an entry has the suffix
        letters = [s for s in strings if LETTERS_ALONE.fullmatch(s)]
        for a in range(0, len(letters), 4096):
            some = letters[a : a + 4096]
            ids = np.array(t.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            to = (np.flatnonzero(ends[ids]) + 1) * 4
            if len(to) == len(some):
                raw = ids.tobytes()
                found.update(zip(some, [raw[i:j] for i, j in zip([0, *to.tolist()], to.tolist(), strict=False)], strict=True))
        rest = [s for s in strings if s not in found]
        found.update(zip(rest, rows(rest), strict=True))
        return [found[s] for s in strings]

    return compute
