"""Fill-in-middle: texts cut at two ranks of their units and rearranged around marks, the cuts found in an indexable skip list.

The list's bottom lane has a node for every few units; each lane above it links over `FAN` nodes of the lane below. A link
carries two widths, how many units and how many code points it passes, so that a descent from the top lane, along links while
their units do not pass the rank, adds up the code points before the cut. Within the last node units are counted one by one.

Units are the matches of a pattern, left to right; what stands between two matches belongs to the unit before it, what stands
before the first to the first. By default each code point is a unit, and widths are counted from the UTF-8 bytes.

Defined cases: a null text counts as empty; an empty text, one that holds a mark, and a text that the draw leaves are plain, with
null prefix_chars and middle_chars; a row without doc_id draws as `1:` alone; equal rows give equal rows; a cut at 0 or at n gives
an empty part, equal cuts an empty middle; texts of any length are cut whole; a table without rows gives none. Only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read, ship, slices, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Bytes, or units of a pattern, in a bottom node, and nodes below a link.
NODE, FAN = 64, 16

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


class SkipList:
    """The lanes over one text: lane 0 has a link for each node, the last lane at most `FAN` links."""

    def __init__(self, text: bytes, pattern: re.Pattern[str] | None = None) -> None:
        self.text, self.widths = text, None
        if pattern is None:
            starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            points = np.add.reduceat(starts, np.arange(0, len(text), NODE), dtype=np.int64) if text else np.zeros(0, np.int64)
            lane = np.stack([points, points], 1)
        else:
            self.decoded = text.decode("utf-8", "surrogateescape")
            begins = [m.start() for m in pattern.finditer(self.decoded)]
            self.widths = np.diff([*begins[1:], len(self.decoded)], prepend=0).tolist() if begins else []
            nodes = [self.widths[i : i + NODE] for i in range(0, len(self.widths), NODE)]
            lane = np.array([(len(x), sum(x)) for x in nodes], np.int64).reshape(-1, 2)
        self.lanes = [lane.tolist()]
        while len(lane) > FAN:
            lane = np.add.reduceat(lane, np.arange(0, len(lane), FAN), axis=0)
            self.lanes.append(lane.tolist())
        self.n = int(lane[:, 0].sum())

    def find(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of a rank from 0 to n."""
        units = points = at = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            at = min(at * FAN, len(lane)) if level < len(self.lanes) - 1 else 0
            while at < len(lane) and units + lane[at][0] <= rank:
                units += lane[at][0]
                points += lane[at][1]
                at += 1
        return self._within(rank, units, points, at)

    def _within(self, rank: int, units: int, points: int, node: int) -> tuple[int, int]:
        """The rest of a descent: `units` and `points` lie before the node of that number in the bottom lane."""
        if self.widths is not None:
            points += sum(self.widths[units:rank])
            return points, len(self.decoded[:points].encode("utf-8", "surrogateescape"))
        place = min(node * NODE, len(self.text))
        while place < len(self.text) and (units < rank or self.text[place] & 0xC0 == 0x80):  # a unit's later bytes belong to it
            units += self.text[place] & 0xC0 != 0x80
            points += self.text[place] & 0xC0 != 0x80
            place += 1
        return points, place


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def arrange(text: bytes, doc_id: int | None, seed: int = SEED, pattern: re.Pattern[str] | None = None) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, code points of prefix and of middle)."""
    lanes = SkipList(text, pattern)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        return text, "plain", lanes.n, None, None
    a, b = sorted((h1 % (lanes.n + 1), h2 % (lanes.n + 1)))
    (pa_, ba), (pb, bb) = lanes.find(a), lanes.find(b)
    prefix, middle, suffix = text[:ba], text[ba:bb], text[bb:]
    if h4 % 100 < SPM_BELOW:
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, "spm", lanes.n, pa_, pb - pa_
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, "psm", lanes.n, pa_, pb - pa_


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of. A mark cannot arise where a part meets a mark, so the first one found is the one put there."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    first, rest = output[len(PREFIX) :].split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return first + middle + other if form == "psm" else other + middle + first


def transform(docs: DataFrame, seed: int = SEED, unit: str | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text in `output` for each document."""
    names = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in names.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for b in slices(it, 512):
            ids = b.column(0).to_pylist()
            rows = [arrange(t, i, seed, pattern) for i, t in zip(ids, texts(b), strict=True)]
            output, form, n, prefix, middle = zip(*rows, strict=True)
            yield batches({"doc_id": ids, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}, schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, names).withColumn("output", F.col("output").cast("string"))


def restored(transformed: DataFrame) -> DataFrame:
    """Adds `restored`: the text rebuilt from output and form."""
    names = [f"{n} {t}" for n, t in transformed.dtypes]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 512):
            forms = b.column(b.schema.get_field_index("form")).to_pylist()
            back = [restore(o, f) for o, f in zip(texts(b, "output"), forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary())], names=[*b.schema.names, "restored"])

    return transformed.mapInArrow(run, ", ".join([*names, "restored binary"])).withColumn("restored", F.col("restored").cast("string"))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    both = restored(transform(read(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_H = "cast(('0x' || substring(h, {}, 8)) as bigint)"
ORACLE_SQL = f"""with t as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    d as (select *, {_H.format(1)} % (n + 1) as a, {_H.format(9)} % (n + 1) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {_H.format(17)} % 100 >= 90 then 'plain' when {_H.format(25)} % 100 < 20 then 'spm' else 'psm' end as form from t),
    c as (select *, least(a, b) as x, greatest(a, b) as y from d), p as (select *, substring(t, 1, x) as prefix, substring(t, x + 1, y - x) as middle, substring(t, y + 1) as suffix from c)
    select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars, case when form <> 'plain' then y - x end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p"""
