"""Queries read texts to their end."""

import pytest
from pyspark.sql import functions as F

from tagweave.functions import rules
from tagweave.operators import tfidf
from tagweave.plans import registry

QUERIES = registry.queries()
FILL = "plain filler of no rule " * 20


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Rule words after the 480th character, in documents whose dealt phrase is `plain words`."""
    d = str(tmp_path_factory.mktemp("whole"))
    late = {4: "the pharaoh of mesopotamia", 14: "photosynthesis", 24: "calculus", 34: "rename your file name", 64: "nothing", 54: "upload it"}
    spark.createDataFrame([(k, FILL + v) for k, v in late.items()], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize(
    "name, column, doc, want",
    [
        ("f3_infer_grades", "math", 24, "9-12"),
        ("f4_infer_grades_history", "grades", 4, "6"),
        ("f5_infer_grades_science", "grades", 14, "MS"),
        ("f6_match_rules", "science", 14, "LS1"),
        ("f7_counts_toward_coverage", "counts", 34, False),
        ("f9_skip_reason", "reason", 54, "logistical"),
    ],
)
def test_rules_see_the_end(spark, docs, name, column, doc, want):
    got = {r.doc_id: r[column] for r in QUERIES[name](spark, docs).collect()}
    assert got[doc] == want and got[64] != want and len(got) == 6


def test_all_lines_are_walked(spark, tmp_path):
    lines = [f"Line{k} " + "word " * 20 + f"end{k}" for k in range(100)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "Only one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["g11_walk_clusters"](spark, str(tmp_path)).collect()
    assert [r.text for r in rows if r.doc_id == "2"] == ["Only one"]
    got = {r.text for r in rows} | {r.cluster for r in rows}
    assert all(x in got or f"Represent {x.lower()}." in got for x in lines)


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("benchmark"))
    texts = {k: f"Begin{k} " + "some words " * 12 + "Science\nand more." for k in range(1, 6)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts


def test_coded_texts_are_whole(spark, benchmark):
    d, texts = benchmark
    flat = {k: " ".join(t.split()) for k, t in texts.items()}
    body = {r.doc_id: r.body for r in QUERIES["g7_split_coded_text"](spark, d).where("n = 1").collect()}
    assert all(body[k].startswith(f"{t}* [Clarification") for k, t in flat.items())
    assert {r.doc_id: r.statement for r in QUERIES["g8_split_annotations"](spark, d).collect()} == flat
    got = {r.doc_id: r.text for r in QUERIES["g9_derive_code_parts"](spark, d).where("grade = 'HS'").collect()}
    assert got == {k: f"{t} look {k}" for k, t in flat.items()}


def test_numbered_items_hold_the_texts(spark, benchmark):
    d, texts = benchmark
    got = {(r.doc_id, r.number): r.item_text for r in QUERIES["g12_extract_numbered"](spark, d).collect()}
    assert got == {(k, 1): f"First {k} {t} see 1. Again" for k, t in texts.items()} | {(k, 2): f"Second item {k} {t} too" for k, t in texts.items()}


def test_lists_are_parsed_to_the_end(spark, tmp_path):
    items = [f"Item number {k}" for k in range(60)]
    spark.createDataFrame([(1, ", ".join(items))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["p18_parse_list"](spark, str(tmp_path)).first()["items"].split("|") == sorted(x.lower() for x in items)


def test_excerpts_come_from_whole_turns(spark, tmp_path):
    """The helper's best chunk of the whole turn lies after its 300th character."""
    best = "Photosynthesis feeds chlorophyll producers everywhere"
    rows = [(1, 0, "user", "Some short filler sentence. " * 15 + best + "."), (1, 1, "assistant", "Photosynthesis feeds chlorophyll producers everywhere indeed")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.ord: r.excerpt for r in QUERIES["p21_best_excerpt"](spark, str(tmp_path)).collect()}
    assert got[0] == f"{best}."


def test_shows_in_report_needs_a_tag(spark):
    rows = [(1, "task", ["a"], "write", True), (2, "task", [], "write", False), (3, "task", None, "write", False), (4, "teacher", ["a"], "write", False), (5, "task", ["a"], "rename your file", False)]
    df = spark.createDataFrame(rows, "id int, kind string, tags array<string>, text string, want boolean")
    assert all(r.got == r.want for r in df.select("want", rules.shows_in_report("kind", F.lit(""), "tags", "text").alias("got")).collect())


def test_each_subject_is_a_corpus(spark):
    """Lists of several subjects at once equal those of each subject alone, with k records in each."""
    records = [(s, f"{s}{k}", k, t) for s, texts in {"ela": ["red fox", "red hen", "old dog"], "math": ["red sum", "blue sum", "fox"]}.items() for k, t in enumerate(texts)]
    corpus = spark.createDataFrame(records, "subject string, record_id string, ord int, text string")
    queries = spark.createDataFrame([(q, s, t) for q, t in enumerate(["red fox sum", "none at all"]) for s in ("ela", "math")], "query_id int, subject string, text string")

    def rows(df):
        return {(r.query_id, r.rank): (r.record_id, round(r.score, 9)) for r in df.collect()}

    both = tfidf.shortlist(queries, corpus, 2, by=["subject"])
    everywhere = tfidf.shortlist(queries.select("query_id", "text").distinct(), corpus, 2, by=["subject"])
    assert sorted(both.collect()) == sorted(everywhere.select(*both.columns).collect())
    for s in ("ela", "math"):
        alone = tfidf.shortlist(queries.where(F.col("subject") == s), corpus.where(F.col("subject") == s), 2)
        assert rows(both.where(F.col("subject") == s)) == rows(alone) and len(rows(alone)) == 4
