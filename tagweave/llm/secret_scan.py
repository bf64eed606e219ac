"""Secret scan: three base patterns, and sliding-window entropy over candidate strings.

A candidate is a run of 20 or more `[A-Za-z0-9+/_-]`, with up to two `=`, that has a digit and a letter. It belongs to
the narrowest character class that holds it (hex, one-case alphanumeric, mixed). A window of the class's width slides over it;
the Shannon entropy of the window follows from character counts that each step changes by one in and one out. Windows at
or above the class's threshold are joined to spans. Candidates that are allow-listed as a whole (UUIDs, counting-up runs, sample
words; not keys that merely hold one) and spans inside a base span are dropped.

Defined cases: a null or empty text has no spans; offsets are code points, end exclusive; equal rows give equal rows; a table
without rows gives none; texts of any length are scanned whole; spans that start together are in the order of KINDS; scan() reads
doc_id and text alone, whatever other columns are called, and redact() hands all other columns on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read, ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: name, members, window, least entropy in bits
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 3.0),
    ("alnum", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 20, 3.6),
    ("mixed", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
#: Candidates that consist of nothing else are no secrets: UUIDs, and stock words and runs of samples.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(
        r"(?i)(?>example|sample|placeholder|changeme|change|replace|dummy|fake|test|your|my|this|is|not|real|insert|here|api|access|secret|private|public|client|auth|bearer|"
        r"key|token|password|value|string|id|x{3,}|0123456789|1234567890|12345678|abcdefghijklmnopqrstuvwxyz|abcdefgh|abcdef|abcd|[0-9/+_-])++={0,2}"
    ),
)
_XLOGX = [0.0, *(n * math.log2(n) for n in range(1, 65))]


def entropy_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Spans of s covered by windows of `width` characters whose entropy is `least` or more."""
    counts: dict[str, int] = {}
    total, spans, log_w = 0.0, [], math.log2(width)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _XLOGX[n + 1] - _XLOGX[n]
        if i >= width:
            old = s[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += _XLOGX[n - 1] - _XLOGX[n]
        if i >= width - 1 and log_w - total / width >= least - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not re.search(r"[0-9]", s) or not re.search(r"[A-Za-z]", s) or any(a.fullmatch(s) for a in ALLOWED):
            continue
        _, _, width, least = next(c for c in CLASSES if c[1].fullmatch(s))
        out += [(m.start() + a, m.start() + b) for a, b in entropy_windows(s, width, least)]
    return out


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order; the base kinds first where starts are equal."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = [(a, 3, b) for a, b in entropy_spans(text) if not any(s <= a and b <= e for s, _, e in base)]
    return sorted(base + more)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, all spans, and the digest of the base ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: dict[str, list] = {f.name: [] for f in _OUT}
            cols["doc_id"] = b.column(0).to_pylist()
            for t in b.column(1):
                spans = find_spans(t.as_py() or "")
                for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_entropy")):
                    cols[name].append(sum(s[1] == k for s in spans))
                cols["base_sha256"].append(hashlib.sha256(told([s for s in spans if s[1] < 3]).encode()).hexdigest())
                cols["spans"].append(told(spans))
            yield batches(cols, _OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same documents with every span replaced by `mark`; n_chars is brought up to date."""
    schema = docs.schema
    i = schema.fieldNames().index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [t and redacted(t, find_spans(t), mark) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return scan(read(spark, sf_dir, "documents"))
