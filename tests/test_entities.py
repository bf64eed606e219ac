"""Entities of HTML: the rule of clean_text() in Python, Spark and SQL; decoding without Python where columns can do it."""

import contextlib
import html
import io
import random
import re

import duckdb
import pandas as pd
import pytest

from tagweave.functions import text as X
from tagweave.plans import registry

PIECES = [
    "&", "amp", "lt", ";", "#", "x", "65", "FEFF", "38", "D800", "110000", "99999999", "&amp;", "&copy", "&notit;", "&ndash;", " ", "é", "😀", "\n", "quot", "&#38;", "&#x26;", "&AMP", "&#128;", "<b>", "7;", "&#1;",
    "&#xFFFE", "&#000000000000000000000000000000065;", "\x0b", "\x85", "&ampere", "'",
]


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    return pd.DataFrame(list(enumerate([None, "", "a &amp b&copy", "&amp;quot; &notit; &#x80;", *made])), columns=["page_id", "html"])


def cleaned(t):
    return re.sub(r"[\t-\r \x85\xa0  -     　]+", " ", html.unescape(re.sub("<[^>]+>", " ", t or ""))).strip(" ")


def test_sql_of_clean_text_states_its_rule(pages):
    con = duckdb.connect()
    con.register("pages", pages)
    assert dict(con.execute(registry.oracle_sql()["p2_clean_text"]).fetchall()) == {i: cleaned(t) for i, t in pages.itertuples(index=False)}


def decoded(t):
    def number(n, whole):
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else whole

    t = re.sub(r"&#([0-9]{1,9});|&#x([0-9a-fA-F]{1,8});", lambda m: number(int(m[1]), m[0]) if m[1] else number(int(m[2], 16), m[0]), t or "")
    return re.sub(r"&([a-zA-Z]+);", lambda m: X.NAMED_ENTITIES.get(m[1], m[0]), t)


def test_decoding_equals_plain_python(spark, pages):
    df = spark.createDataFrame(list(pages.itertuples(index=False, name=None)), "page_id int, html string")
    got = df.select("html", X.clean_text("html").alias("clean"), X.decode_entities("html").alias("decoded")).collect()
    assert [(r.clean, r.decoded) for r in got] == [(cleaned(r.html), decoded(r.html)) for r in got]


def test_decoding_needs_no_python(spark):
    df = spark.createDataFrame([("a",)], "t string").select(X.strip_html("t"), X.decode_entities("t"), X.preview_text("t"), X.html_blocks("t"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert "EvalPython" not in plan.getvalue()
