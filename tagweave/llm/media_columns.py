"""Media columns: texts stored as 8-bit WAV files in content-defined chunks, rebuilt from deduplicated chunks.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples of a mono 8-bit WAV file. The samples
are cut where a gear hash of the last 32 bytes has 10 leading zero bits, at least MIN_CHUNK and at most MAX_CHUNK bytes apart
(1 KB on average), so equal passages of a few KB give equal chunks wherever they stand, the openings of files of different length
too. A document keeps the ordered list of its chunks' digests and the digest of its whole file; each chunk's bytes are kept once,
compressed. The header, which follows from the number of samples, stands in front of the list and in no chunk. Spark joins lists
and chunks, each different file is put together in order, header first, held against the digest that the file had when it was
stored, and read as WAV.

Defined cases: a null or empty text is 64 zero samples; equal texts share one file and get equal values; each input row
gets its own row; a table without rows gives none; texts of any length are stored whole; of equal chunks any one serves; a file
that does not match its digest ends the job with an error. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, read, ship, slices, texts

MIN_CHUNK, MAX_CHUNK, ZERO_BITS, WINDOW = 256, 8192, 10, 32
RATE = 8000
LEVEL, SAMPLE_DOCS, DICTIONARY_BYTES = 19, 4096, 400_000
#: Bytes of the digest of a chunk, and of a file, against which what is rebuilt is held.
DIGEST = 16
_BLOCK = 1 << 20
#: Digests that a task remembers so as to send a chunk's bytes once.
_REMEMBERED = 1 << 20
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=97) for b in range(256)], np.uint32)


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def wav_header(n: int) -> bytes:
    """The header of a mono 8-bit PCM file of n samples (n even)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def cut_points(data: bytes) -> list[int]:
    """Ends of the content-defined chunks."""
    b = np.frombuffer(data, np.uint8)
    n, start, out = len(b), 0, []
    for at in range(0, n, _BLOCK):
        lead = min(at, WINDOW - 1)
        h = _GEAR[b[at - lead : at + _BLOCK]]
        for shift in (1, 2, 4, 8, 16):
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        for p in (np.flatnonzero(h[lead:] < np.uint32(1 << (32 - ZERO_BITS))) + at + 1).tolist():
            while p - start > MAX_CHUNK:
                start += MAX_CHUNK
                out.append(start)
            if p - start >= MIN_CHUNK:
                start = p
                out.append(p)
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cut_points(payload)
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def file_of(payload: bytes) -> bytes:
    return wav_header(len(payload)) + payload


def features(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    return f"samples={len(x)};mean={total / len(x):.4f};rms={(squares / len(x)) ** 0.5:.4f};crossings={crossings};peak={int(x.max())}"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def lists(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the text's file, the text's length, and the ordered digests of its chunks."""
    schema = pa.schema([("doc_id", pa.int64()), ("file_digest", pa.binary()), ("n_bytes", pa.int64()), ("chunks", pa.list_(pa.binary()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raws = texts(b)
            payloads = list(map(payload_of, raws))
            yield batches({"doc_id": b.column(0).to_pylist(), "file_digest": [digest(file_of(p)) for p in payloads], "n_bytes": list(map(len, raws)), "chunks": [list(map(digest, chunks_of(p))) for p in payloads]}, schema)

    return docs.mapInArrow(run, "doc_id long, file_digest binary, n_bytes long, chunks array<binary>")


def dictionary(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A compression dictionary from the beginnings of a bounded sample of texts; it changes sizes, never contents."""
    n = docs.count()
    rows = docs.select(F.substring("text", 1, MAX_CHUNK).alias("text")).where("text is not null").sample(fraction=min(1.0, sample_docs / max(n, 1)), seed=11).limit(sample_docs).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [c for r in rows for c in chunks_of(payload_of(r.text.encode()))]).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


class Packer:
    """Compresses chunks to frames without magic number and size."""

    def __init__(self, words: bytes):
        given = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=1 << 10, dict_size=len(words), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
        self.pack = zstandard.ZstdCompressor(compression_params=plain, **given).compress
        self.read = zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS, **given)

    def unpack(self, packed: bytes) -> bytes:
        return self.read.decompress(packed, max_output_size=MAX_CHUNK)


def store(docs: DataFrame, words: bytes) -> DataFrame:
    """digest and compressed bytes of each different chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shared.value)
        seen: set[bytes] = set()
        for b in slices(it):
            keys, packed = [], []
            for raw in texts(b):
                for c in chunks_of(payload_of(raw)):
                    k = digest(c)
                    if k not in seen:
                        if len(seen) >= _REMEMBERED:
                            seen.clear()
                        seen.add(k)
                        keys.append(k)
                        packed.append(packer.pack(c))
            yield batches({"digest": keys, "packed": packed}, schema)

    return docs.mapInArrow(run, "digest binary, packed binary").dropDuplicates(["digest"])


_FILE = "file_digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def rebuilt(ordered: DataFrame, words: bytes) -> DataFrame:
    """Puts files together from rows (file, seq, packed) that come in order, and reads them; file_digest is that of what was put together."""
    shared = ordered.sparkSession.sparkContext.broadcast(words)
    names = [c.split()[0] for c in _FILE.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FILE.split(", ")])

    def described(parts: list[bytes]) -> tuple:
        media = file_of(b"".join(parts))
        with wave.open(io.BytesIO(media)) as w:
            payload = w.readframes(w.getnframes())
        return digest(media), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).digest(), features(payload)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shared.value)
        file, parts = None, []
        for b in slices(it):
            rows = []
            for k, _, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != file:
                    if file is not None:
                        rows.append(described(parts))
                    file, parts = k, []
                parts.append(packer.unpack(z))
            yield batches(dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)), schema)
        if file is not None:
            yield batches(dict(zip(names, zip(described(parts), strict=True), strict=True)), schema)

    return ordered.select("file", "seq", "packed").mapInArrow(run, _FILE)


def store_and_read(docs: DataFrame) -> DataFrame:
    """One row per document with what the file read back from the chunk store holds."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = dictionary(plain)
    listed = cut(lists(plain).withColumn("file", F.monotonically_increasing_id()))
    # the first row of each different file stands for it
    first = listed.groupBy("file_digest").agg(F.min("file").alias("file")).select("file")
    places = listed.select("file", "chunks").join(first, "file").select("file", F.posexplode("chunks").alias("seq", "digest"))
    found = places.join(store(plain, words), "digest").select("file", "seq", "packed")
    files = rebuilt(found.repartition("file").sortWithinPartitions("file", "seq"), words)
    out = listed.select("doc_id", "file_digest", "n_bytes").join(files, "file_digest", "left")
    lost = F.raise_error(F.concat(F.lit("no file read back has the digest "), F.hex("file_digest")))
    checked = F.when(F.col("payload_bytes").isNull(), lost.cast("long")).otherwise(F.col("payload_bytes"))
    return out.withColumn("payload_bytes", checked).withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}).drop("file_digest")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return store_and_read(read(spark, sf_dir, "documents"))
