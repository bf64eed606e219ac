"""Column functions on HTML and plain text."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Named entities that decode_entities() knows.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.pandas_udf(ArrayType(StringType()))
def _unescape(references: pd.Series) -> pd.Series:
    return references.map(lambda a: [html.unescape(x) for x in a], na_action="ignore")


#: What html.unescape() takes for a reference, and the numeric ones that decode_entities() knows.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NUMERIC = r"&#(?:[0-9]{1,9}|x[0-9a-fA-F]{1,8});"


def _references(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _put(text: Column, pattern: str, values: Column) -> Column:
    """The text with a value in place of each match of a pattern."""
    return F.array_join(F.zip_with(F.split(text, pattern), values, lambda part, value: F.concat(part, F.coalesce(value, F.lit("")))), "")


def _character(reference: Column) -> Column:
    """What a numeric reference stands for; itself if that is no character."""
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);$", 1)
    n = F.when(F.substring(reference, 3, 1) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    # the mark of the byte order in front goes, so that one behind it stays
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    return F.when((n < 0x110000) & ~n.between(0xD800, 0xDFFF), char).otherwise(reference)


def clean_text(col: Column | str) -> Column:
    """Tags to spaces, then HTML entities decoded, then white space collapsed; null gives an empty text."""
    bare = F.regexp_replace(F.coalesce(_c(col), F.lit("")), "<[^>]+>", " ")
    plain = F.when(F.contains(bare, F.lit("&")), _put(bare, _REFERENCE, _unescape(_references(bare, _REFERENCE)))).otherwise(bare)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def decode_entities(col: Column | str) -> Column:
    """Numeric and thirteen named entities; others stay as they are."""
    text = F.coalesce(_c(col), F.lit(""))
    text = F.when(F.contains(text, F.lit("&#")), _put(text, _NUMERIC, F.transform(_references(text, _NUMERIC), _character))).otherwise(text)
    for name in sorted(NAMED_ENTITIES, key=lambda n: n == "amp"):  # the ampersand last, so that none is decoded twice
        text = F.replace(text, F.lit(f"&{name};"), F.lit(NAMED_ENTITIES[name]))
    return text


def _trim(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def _with_breaks(col: Column | str) -> Column:
    text = F.coalesce(_c(col), F.lit(""))
    text = F.regexp_replace(text, r"(?i)<\s*br\s*/?\s*>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6])\s*>", "\n\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "• ")
    return decode_entities(F.regexp_replace(text, "<[^>]+>", ""))


def strip_html(col: Column | str) -> Column:
    """Plain text that keeps line and paragraph breaks and marks list items."""
    text = F.regexp_replace(_with_breaks(col), r"[ \t]+", " ")
    return _trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def preview_text(col: Column | str, n: int = 220) -> Column:
    """One line of at most n characters; a longer one ends with an ellipsis."""
    plain = _trim(F.regexp_replace(strip_html(col), r"(?U)\s+", " "))
    return F.when(F.length(plain) > n, F.concat(F.regexp_replace(F.substring(plain, 1, n - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(plain)


def html_blocks(col: Column | str) -> Column:
    """The non-empty paragraphs as an array of one-line texts."""
    blocks = F.transform(F.split(_with_breaks(col), r"\n{2,}"), lambda b: _trim(F.regexp_replace(b, r"(?U)\s+", " ")))
    return F.filter(blocks, lambda b: b != "")


def parse_path(col: Column | str) -> Column:
    """`sections[N].objectives[M]` as a struct of two ints; what does not parse is 0."""

    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(_c(col), pattern, 1).try_cast("int"), F.lit(0))

    return F.struct(number(r"sections\[(\d+)\]").alias("section_idx"), number(r"objectives\[(\d+)\]").alias("objective_idx"))


def parse_list(col: Column | str, lower: bool = False, distinct: bool = False) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    out = F.filter(F.transform(F.split(F.coalesce(_c(col), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    out = F.transform(out, F.lower) if lower else out
    return F.array_distinct(out) if distinct else out


def parse_json_loose(col: Column | str, schema: str) -> Column:
    """The JSON of a text, else of its outermost braces, else null."""
    whole = F.from_json(_c(col), schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(_c(col), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})

    def ok(parsed: Column, raw: Column) -> Column:
        return F.when(F.try_parse_json(raw).isNotNull(), parsed)

    return F.coalesce(ok(whole, _c(col)), ok(inner, F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)))


def find_excerpt(text: Column | str, excerpt: Column | str) -> Column:
    """Struct start, end (0-based, exclusive) and match of an excerpt: exact, else without regard to case, else null."""
    t, e = _c(text), F.trim(_c(excerpt))
    at = F.instr(t, e)
    found = F.when(at > 0, at).otherwise(F.instr(F.lower(t), F.lower(e)))
    size = F.length(e)
    return F.when((e != "") & (found > 0), F.struct((found - 1).alias("start"), (found - 1 + size).alias("end"), F.substring(t, found, size).alias("match")))


def words(col: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def ngrams(col: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """The words and the pairs of adjacent remaining words."""
    w = words(col, stop_words)
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(w, F.array_compact(pairs))
