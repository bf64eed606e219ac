"""Line-first quality rules: judge each line, drop the failing ones, then judge what is left of the document.

A line with a word fails if
  punctuation  it has more than `heading_words` words and does not end in closing punctuation,
  navigation   it has `min_separators` or more menu separators, one for at most `words_per_separator` words,
  boilerplate  it is short and holds a stock phrase of web pages, or `[#*$%&|<>]` make up over a tenth of it,
               or all its cased letters are capitals (three words or more), or it repeats two earlier equal lines.
A document is rejected if it fails the base rules (fewer than 10 words, or over a fifth of its words in repeated
five-word windows) or if over `max_lost` of the characters of its lines went with failing lines.

Defined cases: a null or empty text has no words and is rejected; equal rows get equal results, one row for each
input row; lines without a word are kept and never judged; texts and lines of any length are judged whole; of equal lines the
first two stay, and a document exactly at a bound stays; an empty table gives an empty result. Only doc_id and
text are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read, ship, texts

WS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
SEPARATORS = "|»›•·"
CLOSING = ".!?:;\"')]}»”’…。"
PHRASES = (
    "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "lorem ipsum", "click here", "sign up", "log in", "subscribe to", "powered by", "share this", "read more",
)

RULES = {"heading_words": 3, "min_separators": 3, "words_per_separator": 6, "phrase_words": 12, "max_lost": 0.5}

_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_dropped long, chars_lost long, clean_text string"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words which occurs twice or more."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    w = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        w = (w ^ h[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    rep = np.zeros(len(w), bool)
    rep[order[1:][same]] = True
    rep[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(width):
        covered[i : i + len(w)] |= rep
    return int(covered.sum())


def line_fails(line: str, words: int, earlier: int, rules: dict) -> bool:
    body = line.rstrip(" \t\x0b\x0c\r")
    if words > rules["heading_words"] and body[-1] not in CLOSING:
        return True
    if earlier >= 2:
        return True
    if words >= 3 and body.isupper():
        return True
    raw = body.encode()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if symbols and 10 * symbols > len(raw.translate(None, WS + CONTINUATION)):
        return True
    separators = sum(map(body.count, SEPARATORS))
    if separators >= rules["min_separators"] and separators * rules["words_per_separator"] >= words:
        return True
    if words <= rules["phrase_words"]:
        low = body.lower()
        return any(p in low for p in PHRASES)
    return False


def judge(raw: bytes, rules: dict) -> tuple:
    words = raw.split()
    n = len(words)
    kept_lines, seen = [], {}
    dup = total = lost = dropped = 0
    for line in raw.decode().split("\n"):
        count = len(line.encode().split())
        if not count:
            kept_lines.append(line)
            continue
        earlier = seen.get(line, 0)
        seen[line] = earlier + 1
        dup += earlier > 0
        total += len(line)
        if line_fails(line, count, earlier, rules):
            dropped += 1
            lost += len(line)
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = n < 10 or 100 * repeat > 20 * n
    return (
        n, len(raw.translate(None, WS + CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat,
        failed, not failed and lost <= rules["max_lost"] * total, dropped, lost, "\n".join(kept_lines),
    )


def apply_rules(docs: DataFrame, **rules) -> DataFrame:
    """One row per document: the base measures, the verdict and the text without its failing lines."""
    use = RULES | rules
    names = [c.split()[0] for c in _OUT.split(", ")]
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in _OUT.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [judge(t, use) for t in texts(b)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield batches(dict(zip(names, [b.column(0).to_pylist(), *cols], strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, with failing lines removed from their text and n_chars brought up to date; same columns."""
    use = RULES | rules
    schema = docs.schema
    i = schema.fieldNames().index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            verdicts = [judge(t, use) for t in texts(b)]
            keep = pa.array([v[6] for v in verdicts], pa.bool_())
            clean = pa.array([v[9] for v in verdicts], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), clean).filter(keep)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply_rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_dropped", "chars_lost")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


#: The same rows in DuckDB, for tables whose doc_id is unique and not null.
ORACLE_SQL = rf"""with d as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
    win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
    rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
    cov as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from rep) group by 1),
    l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from (select doc_id, string_split(t, chr(10)) as ls from d)),
    m as (select doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as nw, regexp_replace(line, '[\x20\x09-\x0D]+$', '') as body from l),
    e as (select *, row_number() over (partition by doc_id, line order by i) - 1 as earlier, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as sym,
        length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) as chars, length(body) - length(regexp_replace(body, '[{SEPARATORS}]', '', 'g')) as sep from m where nw > 0),
    f as (select *, (nw > {RULES["heading_words"]} and not contains('{_quoted(CLOSING)}', right(body, 1))) or earlier >= 2 or (nw >= 3 and upper(body) = body and lower(body) <> body)
        or 10 * sym > chars or (sep >= {RULES["min_separators"]} and sep * {RULES["words_per_separator"]} >= nw)
        or (nw <= {RULES["phrase_words"]} and regexp_matches(lower(body), '{_quoted("|".join(PHRASES))}')) as fails from e),
    s as (select doc_id, count(*) filter (where earlier > 0) as dup, sum(length(line)) as total, coalesce(sum(length(line)) filter (where fails), 0) as lost, count(*) filter (where fails) as dropped from f group by 1),
    b as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(dup, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, coalesce(dropped, 0) as lines_dropped, coalesce(lost, 0) as chars_lost, coalesce(total, 0) as total
        from w left join s using (doc_id) left join cov using (doc_id))
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
    cast(n_repeat_words as bigint) as n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and chars_lost <= {RULES["max_lost"]} * total as kept, cast(lines_dropped as bigint) as lines_dropped, cast(chars_lost as bigint) as chars_lost from b"""
