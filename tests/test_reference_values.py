"""Expected rows written by hand, case by case, for operators whose rules are easily misread."""

import json

import pytest
from pyspark.sql import functions as F

from tagweave.operators import analytics, catalog, curation, flatten, segment
from tagweave.sources import documents

TAGS = "array<struct<code string, confidence string>>"


def only(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_documents_without_counted_objectives_have_cards_and_reports(spark):
    rows = [("a", 0, True, [("x", "high"), ("y", "low")]), ("a", 1, True, [("z", "high")]), ("a", 0, False, [("x", "high"), (None, "low"), ("w", "medium")]), ("a", 0, True, []), ("b", 1, True, [("x", "high")]), ("c", 0, False, [("x", "high")])]
    objs = spark.createDataFrame(rows, f"doc_id string, section_idx int, counts boolean, tags {TAGS}")
    out = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, section_idx int")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    assert only(analytics.document_cards(objs, out), "doc_id", "n_objectives", "n_aligned", "n_codes") == [("a", 2, 1, 3), ("b", 0, 0, 0), ("c", 0, 0, 1)]
    report = analytics.alignment_report(objs, out, docs)
    assert only(report, "doc_id", "n_objectives", "n_aligned", "high", "medium", "low", "pct_aligned") == [("a", 2, 1, 1, 0, 1, 50), ("b", 0, 0, 0, 0, 0, 0), ("c", 0, 0, 0, 0, 0, 0), ("d", 0, 0, 0, 0, 0, 0)]


def test_usage_knows_exclusions_and_taxonomies(spark):
    tags = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 0, "z"), ("b", 0, ""), ("a", 0, None)], "doc_id string, section_idx int, code string")
    out, under = spark.createDataFrame([("a", 1)], "doc_id string, section_idx int"), spark.createDataFrame([("a",)], "doc_id string")
    assert only(analytics.usage_index(tags, out), "code", "doc_id") == [("x", "a"), ("x", "b"), ("z", "b")]
    assert only(analytics.usage_index(tags, out, under), "code", "doc_id") == [("x", "a")]
    records = spark.createDataFrame([("x", "X text"), ("y", "Y"), ("q", "Q")], "code string, text string")
    assert only(analytics.used_records(tags, records), "code", "text") == [("x", "X text"), ("y", "Y")]
    assert only(analytics.used_records(tags, records, out, under), "code", "text") == [("x", "X text")]


def test_normalized_documents(spark):
    o = "struct<title string, description string, evaluation_type string, audience string>"
    objectives = [("Label", "<p>Long &amp; rich</p>", "", None), ("Alone", None, "task", "student"), ("", "", None, None), (None, "Only text", None, ""), (" ", None, None, None)]
    docs = [("d", None, "Named", "<b>About</b> it", "", "9-12", "MATH", [("", None, [("", "", None, None)]), (None, "By name", objectives), ("", "", [("x", "y" * 230, None, None)])]), ("e", "T", "N", None, "8", "9-12", None, None)]
    df = spark.createDataFrame(docs, f"doc_id string, title string, name string, description string, grade string, grade_band string, subject string, sections array<struct<title string, name string, objectives array<{o}>>>")
    d, e = flatten.normalize_document(df).orderBy("doc_id").collect()
    assert (d.title, d.description, d.grade, d.subject, e.title, e.description, e.grade, e.subject, e.sections) == ("Named", "About it", "9-12", "math", "T", "", "8", "other", [])
    assert [(s.title, [tuple(x) for x in s.objectives]) for s in d.sections] == [
        ("By name", [("Label", "Long & rich", None, None), ("Alone", "Alone", "task", "student"), ("", "Only text", None, None), (" ", " ", None, None)]),
        ("Section", [("x", "y" * 219 + "…", None, None)]),
    ]


def test_statuses(spark):
    rows = [(1, False, 0, True, None, False), (2, False, 0, False, "f.pdf", None), (3, None, None, None, "", None), (4, True, 0, False, "f", False), (5, False, 2, True, "f", True), (6, False, 0, True, "f", True)]
    df = spark.createDataFrame(rows, "id int, is_seed boolean, n_aligned int, is_parsed boolean, file_name string, is_tagged boolean")
    assert only(df.select("id", catalog.document_status().alias("s")).select("id", "s.*"), "*") == [
        (1, "raw", "parsed", "pending"), (2, "raw", "needs_parse", "pending"), (3, "raw", "empty", "pending"), (4, "aligned", "needs_parse", "pending"), (5, "aligned", "parsed", "tagged"), (6, "raw", "parsed", "tagged"),
    ]


def test_browsing_documents(spark):
    rows = [(1, "One", "K", "<p>plain</p>", "math", False), (2, "Two", "K", "a" * 300 + "needle", "science", False), (3, "Three", "p8", None, None, True), (4, "Four", None, "&#112;", "ela", None)]
    df = spark.createDataFrame(rows, "id int, name string, grade string, description string, subject string, is_seed boolean").withColumn("n_aligned", F.lit(0))

    def ids(**state):
        return sorted(r.id for r in catalog.filter_documents(df, **state).collect())

    assert ids(search="<p>") == [] and ids(search="needle") == [] and ids(search=" P ") == [1, 3, 4]
    # science is none of the subjects that can be asked for, so its rows pass every one
    assert ids(subject="math") == [1, 2, 3] and ids(subject="science") == [2, 3] and ids(subject="math", subjects=("ela", "math", "science")) == [1, 3]


def test_browsing_records_looks_at_skill_categories(spark):
    names = ("strand_name", "category_name", "domain_name", "skill_category", "course_title")
    df = spark.createDataFrame([("a", 1, None, "", None, "Evidence", "x"), ("b", 2, "Strand", None, None, "Evidence", "x"), ("c", 3, None, None, None, None, "evidence")], "code string, ord int, " + ", ".join(f"{n} string" for n in names))
    page, total = catalog.browse_records(df.withColumn("text", F.lit("t")), search="EVID")
    assert [r.code for r in page.collect()] == ["a"] and total.first().total == 1


def test_patches_are_trimmed(spark):
    rows = spark.createDataFrame([("1", "a", "ela", False, 0), ("2", "b", "ela", None, 0), ("3", "c", "ela", True, 0)], "id string, name string, subject string, is_seed boolean, updated_at int")
    patches = spark.createDataFrame([("1", {"name": " ", "subject": " MATH ", "other": "x"}, 9), ("2", {"name": None, "subject": "  "}, 9), ("3", {"name": "z"}, 9)], "id string, set map<string,string>, updated_at int")
    assert only(catalog.patch_rows(rows, patches, ["name", "subject"]), "id", "name", "subject", "updated_at") == [("1", "", "math", 9), ("2", None, None, 9), ("3", "c", "ela", 0)]


def test_replaced_tags_get_their_text(spark):
    t = "array<struct<code string, confidence string, rationale string, text string>>"
    objs = spark.createDataFrame([("d", "p", [("o", "low", "", "old")]), ("d", "q", []), ("d", "r", [("o", "low", "", "old")])], f"doc_id string, path string, tags {t}")
    changes = spark.createDataFrame([("d", "p", [("b", "high", "r", " "), ("", "low", "", "x"), ("a", "low", "", " own "), ("u", "low", "", None)]), ("d", "r", [])], f"doc_id string, path string, tags {t}")
    texts = spark.createDataFrame([("b", "", 1), ("b", "second", 2), ("b", "third", 3), ("a", "A", 1)], "code string, text string, ord int")
    out = {r.path: r for r in catalog.replace_tags(objs, changes, texts).collect()}
    assert [(x.code, x.rationale, x.text) for x in out["p"].tags] == [("b", "r", "second"), ("a", "", "own"), ("u", "", "")]
    assert out["r"].tags == [] and {(r.n_tags > 0, r.n_objectives, r.n_aligned) for r in out.values()} == {(True, 3, 1), (False, 3, 1)}


def test_document_detail(spark):
    objs = "array<struct<tags array<string>>>"
    docs = spark.createDataFrame([("1", ["A", "B", "Z"], "", "D", "f"), ("2", [], "B", "D", "f"), ("3", None, None, "D", ""), ("4", ["Z"], None, "D", "f")], "id string, taxonomy_ids array<string>, taxonomy_id string, default_id string, file_name string")
    parsed = spark.createDataFrame([("1", [([],), ([],)]), ("3", [([],)])], f"id string, objectives {objs}")
    aligned = spark.createDataFrame([("1", [(["x"],), ([],), ([],)], None), ("2", [(["x"],)], "Stored")], f"id string, objectives {objs}, taxonomy_title string")
    titles = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("D", "Default")], "id string, title string")
    out = catalog.document_detail(docs, parsed, aligned, titles).select("id", "taxonomy_title", "n_objectives", "n_aligned", "status.*")
    assert only(out, "*") == [("1", "Alpha + Beta", 3, 1, "aligned", "parsed", "tagged"), ("2", "Stored", 1, 1, "aligned", "needs_parse", "tagged"), ("3", "Default", 1, 0, "raw", "parsed", "pending"), ("4", None, 0, 0, "raw", "needs_parse", "pending")]


def test_orders(spark):
    def order(rows, schema, by):
        return [r[0] for r in spark.createDataFrame(rows, schema).orderBy(*by).collect()]

    grades = ["HS", "9", "3-5", "K-2", "5", "MS", "K", "4", "1", None, "3", "2"]
    got = order([(g, "t", 1) for g in grades], "grade string, topic string, number int", analytics.science_grade_order())
    assert got[:10] == ["K", "K-2", "1", "2", "3", "4", "3-5", "5", "MS", "HS"] and set(got[10:]) == {"9", None}
    rows = [("a", None, "2024-01-01"), ("b", True, "2025-01-01"), ("c", False, "2023-01-01"), ("d", False, None), ("e", None, "2026-01-01")]
    assert order(rows, "name string, is_seed boolean, created_at string", analytics.catalog_order()) == ["e", "a", "c", "d", "b"]
    assert order(rows, "title string, is_seed boolean, created_at string", analytics.catalog_order(title="title", missing_is_seed=True)) == ["c", "d", "e", "b", "a"]
    assert order([("b",), ("A",), ("C",)], "title string", analytics.catalog_order("name", "title")) == ["A", "b", "C"]
    assert order([("x", 1, 2), ("y", 0, 0), ("z", 3, 3)], "name string, n_aligned int, n_objectives int", analytics.catalog_order("aligned")) == ["z", "x", "y"]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_positions(spark, parts):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = analytics.with_position(df, [F.desc("v")], lambda x: x.cache()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted((i * 7919 % 1009 for i in range(1000)), reverse=True)
    assert sorted(r.position for r in got) == list(range(1, 1001))
    assert analytics.with_position(df.limit(0), ["v"], lambda x: x.cache()).count() == 0


def test_science_items(spark):
    rows = [("K-2-ETS1", 2), ("3-5-ETS1", 1), ("5-PS1", 3), ("K-LS1", 1), ("MS-ESS2", 4), ("HS-PS4", 5), ("X-QQ7", 1)]
    df = spark.createDataFrame([(t, n, "S", "") for t, n in rows], "topic string, number int, statement string, clarification string")
    got = {r.code: (r.grade, r.grade_band, r.domain, r.domain_name, r.topic_number, r.topic_name) for r in segment.derive_code_parts(df, segment.CORE_IDEAS | {"5-PS1": "Own name"}).collect()}
    assert got == {
        "K-2-ETS1-2": ("K-2", "K-5", "ETS", "Engineering, Technology, and Applications of Science", 1, "Engineering Design"),
        "3-5-ETS1-1": ("3-5", "K-5", "ETS", "Engineering, Technology, and Applications of Science", 1, "Engineering Design"),
        "5-PS1-3": ("5", "K-5", "PS", "Physical Sciences", 1, "Own name"), "K-LS1-1": ("K", "K-5", "LS", "Life Sciences", 1, "From Molecules to Organisms: Structures and Processes"),
        "MS-ESS2-4": ("MS", "MS", "ESS", "Earth and Space Sciences", 2, "Earth's Systems"),
        "HS-PS4-5": ("HS", "HS", "PS", "Physical Sciences", 4, "Waves and their Applications in Technologies for Information Transfer"), "X-QQ7-1": ("X", "X", "QQ", "", 7, ""),
    }


def test_numbered_items(spark):
    def items(text, numbers=(1, 2, 3), headings=()):
        df = spark.createDataFrame([("d", text)], "doc_id string, text string")
        return {r.number: r.item_text for r in segment.extract_numbered(df, numbers, headings).collect()}

    assert items("1. Read closely. See 1. Again here. 2. Second item text") == {1: "Read closely. See 1. Again here.", 2: "Second item text"}
    assert items("1. lower start here 1. Upper start here 2. short") == {1: "Upper start here"}
    assert items("in 2.1. not this 1. only lower words Heading Two more") == {1: "only lower words Heading Two more"}
    assert items("1. only lower words Heading Two more", headings=["Heading Two"]) == {1: "only lower words"}
    for tail in ("*Please see the note", "*These broad types", "Note on range and content", "College and Career Readiness anchors", "To build a foundation for college and career readiness in", "*12", " 7", "*"):
        assert items(f"1. Delineate an argument {tail}") == {1: "Delineate an argument"}, tail
    # a tail is cut only where nothing stands on a later line
    assert items("1. Delineate it *Please see\nmore words") == {1: "Delineate it *Please see\nmore words"}


def test_codes_of_skills_and_other_grades(spark):
    items = spark.createDataFrame([("d", 1, "6-8", "CST", 1), ("d", 2, "6-8", None, 2), ("d", 3, "9-12", "HI", 4)], "doc_id string, line_no int, band string, category string, number int")
    assert only(segment.mint_codes(items, "band", category="category"), "code", "parent_code") == [("6-8.CST.1", None), ("9-12.HI.4", None)]
    lines = spark.createDataFrame([(1, "10.1 Students relate", "10"), (2, "11.2 Students of another grade", "10"), (3, "k.1 students in order", "K"), (4, "  12.1. no item", "10"), (5, "10 Students", None), (6, "9.9 STUDENTS", None)], "line_no int, line string, grade string")
    assert [r.line_no for r in segment.skip_other_grades(lines).orderBy("line_no").collect()] == [1, 3, 4, 5]


def test_prompt_records_and_objectives(spark):
    records = spark.createDataFrame([("a", "", "9-12", "x" * 500), ("b", "K", None, None), ("c", None, None, 'q"\n' * 100)], "code string, grade string, grade_band string, text string")
    slim = [{"code": "a", "grade": "9-12", "text": "x" * 400}, {"code": "b", "grade": "K", "text": ""}, {"code": "c", "grade": None, "text": 'q"\n' * 100}]
    size = len(json.dumps(slim, separators=(",", ":")))
    assert {r.code: len(r.text) for r in curation.compact_records(records, size).collect()} == {"a": 400, "b": 0, "c": 300}
    assert {r.code: len(r.text) for r in curation.compact_records(records, size - 1).collect()} == {"a": 400 * (size - 1) // size, "b": 0, "c": 300 * (size - 1) // size}
    o = spark.createDataFrame([("p", "", None, "D", "task", "")], "path string, objective_title string, section_title string, objective_description string, evaluation_type string, audience string")
    assert json.loads(o.select(curation.objective_payload().alias("j")).first().j) == {"path": "p", "title": None, "section_title": None, "description": "D", "evaluation_type": "task", "audience": None}


def test_merged_answers_keep_notes(spark):
    objs = spark.createDataFrame([("d", p, ["o"], "old") for p in "abcde"], "doc_id string, path string, tags array<string>, note string")
    answers = spark.createDataFrame([("d", "a", 1, ["n"], "ignored"), ("d", "b", 1, [], " why \n"), ("d", "c", 1, None, "  "), ("d", "d", 1, ["x"], None), ("d", "d", 2, [], None)], "doc_id string, path string, attempt int, tags array<string>, skip_reason string")
    merged, totals = curation.merge_answers(objs, answers)
    assert only(merged, "path", "tags", "note") == [("a", ["n"], "old"), ("b", [], "why"), ("c", [], "old"), ("d", [], "old"), ("e", ["o"], "old")]
    assert only(totals, "*") == [("d", 5, 2)]


def test_nested_records_round_trip(spark, tmp_path):
    keys = "doc_id string, subject string, section_idx int, objective_idx int, path string"
    cands = spark.createDataFrame([("d", "ela", 0, 1, "p1", 2, "b", 0.5, None), ("d", "ela", 0, 1, "p1", 1, "a", 0.7, ["r"]), ("e", "ela", 0, 0, "p0", 1, "c", 0.1, [])], f"{keys}, rank int, code string, score double, matched array<string>")
    objs = spark.createDataFrame([("d", "ela", 0, 1, "p1", "T1", (["a"], "why")), ("d", "ela", 0, 0, "p0", None, ([], "none")), ("e", "ela", 0, 0, "p0", "T", None)], f"{keys}, title string, auto_pick struct<picks: array<string>, reason: string>")
    heads = spark.createDataFrame([("d", "ela", "Doc", ["9-10"]), ("e", "ela", None, []), ("f", "ela", "Empty", [])], "doc_id string, subject string, title string, grades array<string>")
    nested = documents.to_nested(cands, ["code", "score", "matched"], objs, heads)
    rows = {r.doc_id: r.asDict(recursive=True) for r in nested.collect()}
    assert [(o["path"], o["title"], o["auto_pick"], [(c["rank"], c["code"], c["matched"]) for c in o["candidates"]]) for o in rows["d"]["objectives"]] == [("p0", None, {"picks": [], "reason": "none"}, []), ("p1", "T1", {"picks": ["a"], "reason": "why"}, [(1, "a", ["r"]), (2, "b", None)])]
    assert rows["d"]["grades"] == ["9-10"] and rows["f"]["objectives"] == []
    documents.write_nested(nested, f"file://{tmp_path}/out")
    assert {r.doc_id: r.asDict(recursive=True) for r in spark.read.schema(nested.schema).json(f"file://{tmp_path}/out").collect()} == rows
