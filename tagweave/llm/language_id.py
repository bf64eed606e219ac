"""Language identification by interpolated Kneser-Ney character models.

Training takes a bounded sample of labelled texts: of each language documents drawn by hash, up to `per_language` of them and `chars`
characters (so at most the first `chars` of one text), and up to `total_chars` characters of all languages together, shared evenly. Each model's probabilities
are computed once. Languages go in groups of at most GROUP: for every n-gram that any language of a group has seen, and for every
order, one sorted array of n-gram hashes stands beside a matrix of natural log probabilities, one column a language; contexts have
their backoff weights in the same form. So the model grows with the number of languages, which has no bound but the labels.
Scoring looks whole texts up by binary search, order by order; a character whose n-gram is unknown to all languages of a
group takes the backoff weight of its context and goes on to the next lower order.

The language of lowest cross-entropy per character wins. The score is a softmax over the languages' cross-entropies at
a temperature fitted on a second part of the sample; `rejected` marks texts whose score, or whose cross-entropy, lies outside
what that part shows for right answers.

Defined cases: text that is null or has no letter is `und`, score 0, rejected; ties go to the language that sorts
first; equal texts get equal predictions; repeated rows count once in training; with no labelled text at all everything is
`und`; a table without rows gives none; long texts are scored whole, in blocks. Only doc_id, text and lang are read, lang only
of the training part, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, drop, read, ship, slices, texts

ORDER, PER_LANGUAGE, CHARS, TOTAL_CHARS = 4, 1500, 2_000_000, 24_000_000
#: Languages whose models share sorted arrays.
GROUP = 8
#: Shares of right answers of the calibration part that rejection by score and by cross-entropy may cost.
REJECT_SHARE = 0.005
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 22  # characters times languages that are scored at once


def folded(raw: bytes) -> np.ndarray:
    """Lower-case code points with each run of other characters than letters as one space; empty if there is no letter."""
    s = "".join([c if c.isalpha() else " " for c in raw.decode().lower()]) if not raw.isascii() else raw.lower().translate(_TO_SPACE).decode()
    s = " ".join(s.split())
    return np.frombuffer(f" {s} ".encode("utf-32-le"), np.uint32) if s else np.empty(0, np.uint32)


_TO_SPACE = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n characters that end at each place (the first n - 1 places repeat the text's first character)."""
    cur = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    out = [cur ^ (cur >> np.uint64(31))]
    full = cur.copy()
    for n in range(1, order):
        back = np.concatenate([np.repeat(codes[:1], n), codes[:-n]])[: len(codes)]
        full = (full ^ (full >> np.uint64(29))) * _MIX + (back.astype(np.uint64) + np.uint64(1))
        h = full * _MIX
        out.append(h ^ (h >> np.uint64(31)))
    return out


def _find(sorted_hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of the asked hashes, -1 where there is none."""
    if not len(sorted_hashes):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, asked), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == asked, at, -1)


@dataclass
class KneserNey:
    """Sorted hash arrays of all orders, for the languages of a group at once."""

    languages: list[str]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)  # [n-1] sorted hashes
    logp: list[np.ndarray] = field(default_factory=list)  # [n-1] (entries, languages)
    contexts: list[np.ndarray] = field(default_factory=list)  # [n-1] sorted hashes of contexts of n characters
    weight: list[np.ndarray] = field(default_factory=list)  # [n-1] (entries, languages)
    floor: float = 0.0

    @classmethod
    def fit(cls, samples: dict[str, list[np.ndarray]], order: int = ORDER, alphabet: int = 0) -> KneserNey:
        """`alphabet`: characters that share the mass below single ones with one that stands for all unknown; else those seen."""
        langs = sorted(samples)
        model = cls(langs, order)
        # per language and order: gram hash -> count, its context's hash and its suffix's hash
        seen = [[_counted(samples[g], n) for n in range(1, order + 1)] for g in langs]
        prob: list[list[np.ndarray]] = [[] for _ in langs]
        backoff: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in langs]
        alphabet = alphabet or len(np.unique(np.concatenate([s[0][0] for s in seen])))
        model.floor = float(-np.log(alphabet + 1))
        for i, by_order in enumerate(seen):
            for n in range(1, order + 1):
                gram, count, context, _ = by_order[n - 1]
                if n < order:  # continuation counts: how many characters stand before it
                    kinds, count = np.unique(by_order[n][3], return_counts=True)
                    at = _find(kinds, gram)
                    count = np.where(at >= 0, count[at], 1) if len(kinds) else np.ones(len(gram))
                count = count.astype(float)
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.75
                ctx, place = np.unique(context, return_inverse=True)
                total = np.bincount(place, count, len(ctx))
                lam = d * np.bincount(place, minlength=len(ctx)) / total
                own = np.maximum(count - d, 0) / total[place]
                if n == 1:
                    lower = np.full(len(gram), np.exp(model.floor))
                else:
                    low = by_order[n - 2][0]
                    at = _find(low, by_order[n - 1][3])
                    lower = prob[i][n - 2][at]
                prob[i].append(own + lam[place] * lower)
                backoff[i].append((ctx, lam))
        for n in range(1, order + 1):
            ctx = np.unique(np.concatenate([b[n - 1][0] for b in backoff]))
            weight = np.ones((len(ctx), len(langs)))
            for i, b in enumerate(backoff):
                weight[np.searchsorted(ctx, b[n - 1][0]), i] = b[n - 1][1]
            model.contexts.append(ctx)
            model.weight.append(np.log(weight))
            gram = np.unique(np.concatenate([s[n - 1][0] for s in seen]))
            logp = np.zeros((len(gram), len(langs)))
            context, suffix = np.zeros(len(gram), np.uint64), np.zeros(len(gram), np.uint64)
            for s in seen:
                at = np.searchsorted(gram, s[n - 1][0])
                context[at], suffix[at] = s[n - 1][2], s[n - 1][3]
            lower = np.full((len(gram), len(langs)), model.floor) if n == 1 else model.logp[n - 2][np.searchsorted(model.grams[n - 2], suffix)]
            logp[:] = model.weight[n - 1][np.searchsorted(ctx, context)] + lower
            for i, s in enumerate(seen):
                logp[np.searchsorted(gram, s[n - 1][0]), i] = np.log(prob[i][n - 1])
            model.grams.append(gram)
            model.logp.append(logp)
        return model

    def log_probabilities(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of log probabilities of each text by language; texts are joined, `starts` are their first places."""
        hashes = gram_hashes(codes, self.order)
        # the order at each place is bounded by how much of its own text stands before it
        depth = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) + 1
        out = np.zeros((len(codes), len(self.languages)))
        todo = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            fits = depth[todo] >= n
            here = todo[fits]
            at = _find(self.grams[n - 1], hashes[n - 1][here])
            hit = at >= 0
            out[here[hit]] += self.logp[n - 1][at[hit]]
            miss = here[~hit]
            if n > 1 and len(miss):
                c = _find(self.contexts[n - 1], hashes[n - 2][miss - 1])
                out[miss[c >= 0]] += self.weight[n - 1][c[c >= 0]]
            elif n == 1:
                out[miss] += self.weight[0][0] + self.floor
            todo = np.concatenate([todo[~fits], miss]) if n > 1 else todo[:0]
        return np.add.reduceat(out, starts, axis=0)

    @property
    def block(self) -> int:
        return max(4096, _CELLS // max(1, len(self.languages)))

    def entropies(self, raws: list[bytes]) -> np.ndarray:
        """Cross-entropy a character of each text by language; nan where there is no letter."""
        out = np.full((len(raws), len(self.languages)), np.nan)
        block = self.block
        group, size = [], 0
        for i, raw in enumerate(raws):
            codes = folded(raw)
            if len(codes):
                group.append((i, codes))
                size += len(codes)
            if group and (size >= block or i == len(raws) - 1):
                self._score(group, out)
                group, size = [], 0
        if group:
            self._score(group, out)
        return out

    def _score(self, group: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        """Long texts go in blocks that overlap by the context of their first character."""
        parts, owner = [], []
        for i, codes in group:
            parts.append(codes)
            owner.append((i, len(codes)))
        codes = np.concatenate(parts)
        if len(codes) <= 2 * self.block:
            starts = np.cumsum([0, *(n for _, n in owner[:-1])])
            sums = self.log_probabilities(codes, starts)
        else:
            sums = np.zeros((len(owner), len(self.languages)))
            for k, (_, part) in enumerate(group):
                for a in range(0, len(part), self.block):
                    lead = min(a, self.order - 1)
                    block = part[a - lead : a + self.block]
                    sums[k] += self.log_probabilities(block, np.array([0]))[0]
                    if lead:
                        sums[k] -= self.log_probabilities(block[:lead], np.array([0]))[0]
        for (i, n), s in zip(owner, sums, strict=True):
            out[i] = -s / n


@dataclass
class Identifier:
    """The models of all languages, and how their cross-entropies become a score and a rejection."""

    groups: list[KneserNey]
    temperature: float = 0.05
    least_score: float = 0.0
    most_entropy: float = np.inf

    @classmethod
    def fit(cls, samples: dict[str, list[np.ndarray]], order: int = ORDER, group: int = GROUP) -> Identifier:
        langs = sorted(samples)
        known: set[int] = set()
        for parts in samples.values():
            for codes in parts:
                known.update(np.unique(codes).tolist())
        return cls([KneserNey.fit({g: samples[g] for g in langs[i : i + group]}, order, len(known)) for i in range(0, len(langs), group)])

    @property
    def languages(self) -> list[str]:
        return [g for m in self.groups for g in m.languages]

    def entropies(self, raws: list[bytes]) -> np.ndarray:
        return np.hstack([m.entropies(raws) for m in self.groups])

    def calibrate(self, raws: list[bytes], langs: list[str], share: float = REJECT_SHARE) -> None:
        """Temperature by least log loss on a grid; bounds that cost `share` of the right answers."""
        if not raws:
            return
        h, names = self.entropies(raws), self.languages
        ok = ~np.isnan(h[:, 0])
        h, right = h[ok], np.array([names.index(g) for g in langs])[ok]
        if not len(h):
            return
        grid = np.geomspace(0.01, 1, 21)
        loss = [-np.log(np.maximum(_softmax(h, t)[np.arange(len(h)), right], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        best = h.argmin(1)
        good = best == right
        if good.any():
            self.least_score = float(np.quantile(_softmax(h, self.temperature).max(1)[good], share))
            self.most_entropy = float(np.quantile(h.min(1)[good], 1 - share)) * 1.1

    def predict(self, raws: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text."""
        if not self.groups:
            return ["und"] * len(raws), [0.0] * len(raws), [True] * len(raws)
        h, names = self.entropies(raws), self.languages
        none = np.isnan(h[:, 0])
        h[none] = 0
        score = np.where(none, 0.0, _softmax(h, self.temperature).max(1))
        rejected = none | (score < self.least_score) | (h.min(1) > self.most_entropy)
        return ["und" if x else names[i] for i, x in zip(h.argmin(1), none, strict=True)], score.tolist(), rejected.tolist()


def _softmax(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(h - h.min(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def _counted(parts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-gram hashes of all texts with their counts, contexts (first n - 1 characters) and suffixes (last n - 1)."""
    gram, context, suffix = [], [], []
    for codes in parts:
        h = gram_hashes(codes, n)
        gram.append(h[n - 1][n - 1 :])
        context.append(h[n - 2][n - 2 : -1] if n > 1 else np.zeros(len(codes), np.uint64))
        suffix.append(h[n - 2][n - 1 :] if n > 1 else np.zeros(len(codes), np.uint64))
    gram, context, suffix = (np.concatenate(x) for x in (gram, context, suffix))
    kinds, first, count = np.unique(gram, return_index=True, return_counts=True)
    return kinds, count, context[first], suffix[first]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """lang, text and a draw by hash of the rows that may be learned from."""
    return docs.where("lang is not null and text is not null").where(~held_out()).select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("draw"))


def training_rows(known: DataFrame, sizes: DataFrame, per_language: int, chars: int) -> DataFrame:
    """About `per_language` different rows of each language of `sizes` (lang, size), with at most `chars` characters of each text.

    A row is drawn where its draw is below its language's share, so no language's rows meet in one task.
    """
    share = F.pmod("draw", F.lit(1 << 52)) / float(1 << 52)
    drawn = known.join(F.broadcast(sizes), "lang").where(share * F.col("size") < per_language)
    return drawn.select("lang", F.substring("text", 1, chars).alias("text"), "draw").dropDuplicates(["lang", "draw"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = CHARS, total_chars: int = TOTAL_CHARS, order: int = ORDER) -> Identifier:
    """A model of the labelled texts that are not held out, within the bounds (whole texts, until the next would pass one),
    a quarter of them for calibration."""
    samples: dict[str, list[np.ndarray]] = {}
    check: list[tuple[bytes, str]] = []
    used: dict[str, int] = {}
    known = labelled(docs)
    sizes = cut(known.groupBy("lang").agg(F.count("*").alias("size")))  # one row a language
    chars = max(1, min(chars, total_chars // max(1, sizes.count())))
    rows = training_rows(known, sizes, min(per_language, max(1, chars // 100)), chars)
    for r in rows.orderBy("lang", "draw").toLocalIterator():
        raw = r.text.encode()
        codes = folded(raw)
        if not len(codes) or used.get(r.lang) and used[r.lang] + len(codes) > chars:
            continue
        used[r.lang] = used.get(r.lang, 0) + len(codes)
        own = samples.setdefault(r.lang, [])
        if own and r.draw % 4 == 0:
            check.append((raw, r.lang))
        else:
            own.append(codes)
    drop(sizes)
    model = Identifier.fit(samples, order)
    model.calibrate([c[0] for c in check], [c[1] for c in check])
    return model


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            langs, scores, rejected = shared.value.predict(texts(b))
            yield batches({"doc_id": b.column(0).to_pylist(), "held_out": b.column(2).to_pylist(), "lang_pred": langs, "score": scores, "rejected": rejected}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
