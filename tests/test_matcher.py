"""One pass over all rules finds what each pattern finds alone."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions import matcher as M
from tagweave.functions import rules as R

RULES = M.rules_of()


def alone(text, rules=RULES):
    """Each pattern by itself, as search over the folded text."""
    low = text.translate(M.FOLDED).lower()
    return [n for n, r in enumerate(rules) if re.search(rf"\b(?:{r.words})\b", low, re.I)]


def sample_of(words):
    """Texts that alternatives of a rule match, roughly: options taken or left, spaces put where they may be."""
    for part in R.split_alternatives(words):
        for space in (" ", ""):
            t = re.sub(r"\\s\*|\[- \]\??|\.\?|\.\*|\.\{0,5\}", space, part.replace(r"\b", "").replace(r"\.", "."))
            yield re.sub(r"\(([^|()]*)[^()]*\)\??", r"\1", t).replace("?", "")
            yield re.sub(r"\([^()]*\)\??", "", t)


def test_first_letters():
    assert [M.literal_start(p) for p in R.split_alternatives(r"colou?r|war(s|ring)?|\bvote\b|d[- ]?day|MLA|b\.c\.|a b|\d+x|(x|y)z|food\s*web|y-in")] == ["colo", "war", "vote", "d", "mla", "b.c.", "a b", "", "", "food", "y-in"]


def test_every_alternative_is_found():
    hits = 0
    for rule in RULES:
        for t in sample_of(rule.words):
            for text in (t, f"x {t.upper()}.", f"{t}s", f"a{t}", f"é{t}", f"{t}é", f"({t})\n{t}"):
                assert M.matched_rules(text, RULES) == alone(text), text
                hits += bool(alone(text))
    assert hits > 2000


@given(st.lists(st.sampled_from([w for r in RULES for w in sample_of(r.words)] + ["x", "é", "ſ", "İ", "K", "_", "1"]), max_size=8), st.sampled_from([" ", "", "-", "\n", "\x1c", "é"]))
@settings(max_examples=400, deadline=None)
def test_any_text(parts, between):
    text = between.join(parts)
    assert M.matched_rules(text, RULES) == alone(text)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("b", 1, r"(re)?do", ["x"]), ("a", 2, r"end", ["y", "z"]), ("a", 1, r"\d+ men|enter", ["z"])], "subject string, ord int, words string, targets array<string>")
    rules = M.rules_of(table)
    assert [r.words for r in rules] == [r"\d+ men|enter", "end", r"(re)?do"]
    df = spark.createDataFrame([("the END of 12 men",), ("redo",), ("men",), (None,)], "s string").select(M.matcher(rules)("s").alias("n"))
    got = df.select("n", M.rules_result("n", "a", rules)["boosts"].alias("a"), M.rules_result("n", "b", rules)["boosts"].alias("b"), M.rules_result("n", "c", rules)["matched"].alias("c")).collect()
    assert [(r.n, r.a, r.b, r.c) for r in got] == [([0, 1], ["z", "y"], [], []), ([2], [], ["x"], []), ([], [], [], []), ([], [], [], [])]


@pytest.mark.parametrize("subject", R.SUBJECTS)
def test_equals_the_columns(spark, subject):
    deal = random.Random(4)
    words = [w for r in RULES for w in sample_of(r.words)]
    texts = [" ".join(deal.choices([*words, "plain", "er", "wars"], k=6)) for _ in range(60)] + ["", None, "İndex KelvIn ınfer"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("n", M.matcher()("s"))
    for r in df.select("s", R.match_rules("s", subject).alias("a"), M.rules_result("n", subject).alias("b")).collect():
        assert r.a == r.b, r.s
    assert df.where(F.size("n") > 0).count() > 50


def test_subjects_are_found_in_one_pass(spark):
    texts = [t for words in R.SUBJECT_WORDS.values() for w in sample_of(words) for t in (w, f"x {w.upper()}, y", f"a{w}", f"{w}s")] + ["", None, "nothing at all", "war and essay\natoms"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.array_compact(F.array(*(F.when(R._has("t", R.SUBJECT_WORDS[s]), F.lit(s)) for s in R.SUBJECTS)))
    out = df.select("t", R.detect_subjects("t").alias("got"), F.when(F.size(each) == 0, F.array(F.lit("ela"))).otherwise(each).alias("want"))
    assert out.where("got <> want").count() == 0
    plan = df.select(R.detect_subjects("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan and "RLIKE" not in plan
