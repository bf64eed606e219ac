"""Edge cases of the operators on hand-made rows."""

from pyspark.sql import functions as F

from tagweave.functions import excerpts, grades, rules, text
from tagweave.operators import analytics, catalog, curation, evaluate, flatten, rerank, segment, tfidf
from tagweave.sources import documents


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string")
    return row.select(col.alias("v")).first().v


def test_clean_text(spark):
    rows = [("<p>a &amp; b</p>  c", "a & b c"), ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("&lt;b&gt;", "<b>"), ("&#8217;x", "’x"), (None, ""), ("  ", ""), ("&eacute;&copy", "é©")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select("want", text.clean_text("s").alias("got")).collect())


def test_strip_preview_blocks(spark):
    html = "<p>one<br>two</p><ul><li>x &#x41;</li></ul>&nbsp;&unknown;<p></p>"
    assert one(spark, text.strip_html("s"), s=html) == "one\ntwo\n\n• x A\n\n &unknown;"
    assert one(spark, text.html_blocks("s"), s="<p>a  b</p><p> </p><div>c</div>") == ["a b", "c"]
    assert one(spark, text.preview_text("s", 10), s="<p>abcdefgh ijkl</p>") == "abcdefgh…"


def test_paths_lists_json(spark):
    assert tuple(one(spark, text.parse_path("s"), s="sections[3].objectives[12]")) == (3, 12)
    assert tuple(one(spark, text.parse_path("s"), s="sections[x]")) == (0, 0)
    assert one(spark, text.parse_list("s", lower=True, distinct=True), s=" A, b,,a ") == ["a", "b"]
    assert one(spark, text.parse_json_loose("s", "a int"), s='so {"a": 3} then').a == 3
    assert one(spark, text.parse_json_loose("s", "a int"), s="none") is None
    assert tuple(one(spark, text.find_excerpt("s", F.lit("WORLD")), s="hello world")) == (6, 11, "world")
    assert one(spark, text.find_excerpt("s", F.lit(" ")), s="hello") is None


def test_grades(spark):
    df = spark.createDataFrame([("K", 0), ("K-2", 0), ("9-10", 9), ("12", 12), ("MS", 998), ("unspecified", 999), ("", 999), (None, 999)], "g string, want int")
    assert all(r.got == r.want for r in df.select("want", grades.grade_order_key("g").alias("got")).collect())
    spans = [(["6-8", "9-12"], "6-12"), (["6"], "6"), ([], ""), (["9", "9"], "9, 9"), (None, "")]
    df = spark.createDataFrame(spans, "b array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", grades.grade_span("b").alias("got")).collect())
    assert one(spark, grades.confidence_rank("s"), s="odd") == 3 and one(spark, grades.confidence_value("s"), s="odd") == 60


def test_rules(spark):
    assert one(spark, rules.detect_subjects("s"), s="An essay with a budget") == ["ela", "math"]
    assert one(spark, rules.detect_subjects("s"), s="éessay") == ["ela"] == one(spark, rules.detect_subjects("s"), s="")
    assert one(spark, rules.infer_grades_history("s"), s="World War and ancient Egypt in high school") == ["10", "11", "6"]
    assert one(spark, rules.infer_grades_history("s"), s="high school") == ["10", "11", "12"]
    assert one(spark, rules.infer_grades_science("s"), s="weather in 5th grade") == ["K", "1", "2", "3", "4", "5"]
    assert one(spark, rules.infer_grades_math("s"), s="polynomial, place value") == ["9-12"]
    hit = one(spark, rules.match_rules("s", "ela"), s="write a narrative with a theme")
    assert hit.boosts == ["W 3", "CCRA.W 3", "RL 2", "RI 2", "CCRA.R 2"] and all(len(m) <= 60 for m in hit.matched)
    assert not one(spark, rules.counts_toward_coverage(F.lit("teacher"), F.lit(""), "s"), s="write")
    assert not one(spark, rules.counts_toward_coverage(F.lit(""), F.lit(""), "s"), s="rename your file")
    assert one(spark, rules.counts_toward_coverage(F.lit(""), F.lit(""), "s"), s="rename your file, then write")
    assert one(spark, rules.skip_reason("s", "s", F.lit(0.9)), s="Final reflection 2") == "reflective"
    assert one(spark, rules.skip_reason("s", "s", F.lit(0.2)), s="submit it") == "logistical" and one(spark, rules.skip_reason("s", "s", F.lit(0.4)), s="submit it") is None


CAND = "doc_id string, subject string, path string, rank int, score double, code string, grade string, text string, strand string, is_anchor boolean, domain_code string, is_practice boolean, is_skill boolean, skill_category_code string, topic string, engineering boolean"
OBJ = "doc_id string, subject string, path string, grades array<string>, boosts array<string>, objective_title string, context string"


def sides(spark, subject, cands, grades_, boosts, title="Task", context="words"):
    c = spark.createDataFrame([("d", subject, "p", i, *row) for i, row in enumerate(cands, 1)], CAND)
    return c, spark.createDataFrame([("d", subject, "p", grades_, boosts, title, context)], OBJ)


def ranked(spark, *rest):
    return rerank.rerank(*sides(spark, *rest))


def cand(score, code, grade=None, strand=None, anchor=False, domain=None, practice=False, skill=False, category=None, topic=None, engineering=False):
    return score, code, grade, "t", strand, anchor, domain, practice, skill, category, topic, engineering


def test_rerank_rules(spark):
    out = ranked(spark, "ela", [cand(0.5, "CCRA.R.1", "x", "CCRA.R", True), cand(0.4, "W.9-10.1.b", "9-10", "W"), cand(0.9, "RL.6.2", "6", "RL")], ["9-10"], ["W 1"]).collect()
    assert [(r.code, round(r.final_score, 2)) for r in out] == [("W.9-10.1.b", 0.85), ("RL.6.2", 0.75), ("CCRA.R.1", 0.6)]
    out = ranked(spark, "history", [cand(0.1, "10.70", "10"), cand(0.1, "10.7.2", "10"), cand(0.1, "S", None, skill=True, category="CST")], [], ["10.7", "SKILL:CST"]).collect()
    assert {r.code: round(r.final_score, 2) for r in out} == {"10.70": 0.1, "10.7.2": 0.3, "S": 0.35}
    out = ranked(spark, "science", [cand(0.0, "a", "K-2", topic="K-2-ETS1", engineering=True), cand(0.0, "b", "HS", topic="HS-PS3", engineering=True)], ["K"], ["ETS1"]).collect()
    assert {r.code: round(r.final_score, 2) for r in out} == {"a": 0.3, "b": 0.05}
    out = ranked(spark, "math", [cand(0.0, "MP.4", None, practice=True), cand(0.0, "q", "7", domain="7.RP")], ["7"], ["MP", "7.RP"]).collect()
    assert {r.code: round(r.final_score, 2) for r in out} == {"MP.4": 0.25, "q": 0.4}


def test_auto_pick(spark):
    rows = [cand(s, f"c{i}") for i, s in enumerate((0.5, 0.5, 0.45, 0.43, 0.1))]

    def picked(*rest):
        c, o = sides(spark, *rest)
        r = rerank.auto_pick(rerank.rerank(c, o), o).collect()
        assert len(r) == 1
        return [p.code for p in r[0].picks], r[0].reason

    assert picked("ela", rows, [], []) == (["c0", "c1", "c2"], "top-1 plus any candidate within 85% of top score")
    assert picked("ela", rows, [], [], "Reflection") == ([], "reflective/metacognitive objective, no ELA standard applies")
    assert picked("math", [cand(0.3, "n")], [], [], "x", "submit it") == ([], "logistical/operational objective, no MATH standard applies")
    assert picked("ela", [cand(0.1, "n", "6")], ["K"], [])[0] == []
    assert picked("ela", [], [], []) == picked("ela", [], [], [], "x", "submit it") == ([], "no candidates")
    assert picked("ela", [], [], [], "Reflection")[1].startswith("reflective")


def test_shortlist_is_full_and_sorted(spark):
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(["red fish", "blue fish", "one", "two words", "red red bird"])], "record_id int, ord int, text string")
    queries = spark.createDataFrame([(1, "red fish"), (2, "unknown"), (3, None)], "query_id int, text string")
    out = tfidf.shortlist(queries, corpus, 4).orderBy("query_id", "rank").collect()
    assert len(out) == 12 and [r.record_id for r in out if r.query_id == 2] == [0, 1, 2, 3]
    first = [r for r in out if r.query_id == 1]
    assert first[0].record_id == 0 and abs(first[0].score - 1) < 1e-9 and sorted((r.score for r in first), reverse=True) == [r.score for r in first]


def test_evaluation(spark):
    tags = "array<struct<code string, confidence string>>"
    predicted = spark.createDataFrame([("d", "p1", 1, [("a", "low")]), ("d", "p1", 2, [("a", "high"), ("b", "low")]), ("d", "p3", 1, [])], f"doc_id string, path string, n int, tags {tags}")
    truth = spark.createDataFrame([("d", "p1", 1, [("a", None)]), ("d", "p2", 1, [("c", "high")])], f"doc_id string, path string, n int, tags {tags}")
    pairs = evaluate.pair_objectives(evaluate.code_sets(predicted, 1, "n"), evaluate.code_sets(truth, 1, "n"))
    total = evaluate.precision_recall_f1(evaluate.compare_code_sets(pairs)).where("doc_id is null").first()
    assert (total.n_objectives, total.n_exact, total.tp, total.fp, total.fn) == (3, 1, 1, 1, 1) and total.f1 == 0.5
    floor = evaluate.code_sets(predicted, 2, "n").where("path = 'p1'").first().codes
    assert floor == ["a"]


def test_runs_and_latest(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([0, 0, 1, 0, None, None])], "doc_id string, i int, s int")
    assert [r.run for r in analytics.consecutive_runs(df, "s", ["i"]).orderBy("i").collect()] == [1, 1, 2, 3, 4, 4]
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "id string, ts int, payload string")
    assert catalog.latest_by_key(v, "id", ["ts"]).first().payload is None


def test_flatten_and_query(spark):
    s = "struct<title string, name string, description string, objectives array<struct<title string, description string, evaluation_type string, audience string, points long>>>"
    docs = spark.createDataFrame([("d", "T", "x", [("S", None, None, [("o", "&amp;", None, None, 1)]), ("E", None, None, None)]), ("e", None, None, None)], f"doc_id string, title string, description string, sections array<{s}>")
    out = flatten.compose_query(flatten.flatten_objectives(docs)).collect()
    assert [(r.path, r.query) for r in out] == [("sections[0].objectives[0]", "T. S o &")]


def test_answers(spark):
    rows = [(1, '{"picks": [{"code": "a", "confidence": "high", "rationale": " r "}], "note": ""}'), (2, '{"picks": [{"code": "z", "confidence": "high"}]}'), (3, '{"picks": []}'), (4, "no")]
    df = spark.createDataFrame(rows, "n int, answer string").withColumn("allowed", F.array(F.lit("a")))
    out = {r.n: r for r in curation.validate_answers(df).collect()}
    assert [out[i].valid for i in (1, 2, 3, 4)] == [True, False, True, False] and out[1].picks[0].rationale == "r" and out[1].note is None


def test_segmenting(spark):
    lines = ["intro", "1. First item be-", "gins here", "2. Second co-", "Author", "3. Third"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    out = [r.text for r in segment.assemble_items(df).orderBy("item").collect()]
    assert out == ["1. First item begins here", "2. Second co- Author", "3. Third"]
    marked = one(spark, F.struct("s"), s="(+) Do it ★ CA.")
    got = segment.extract_markers(spark.createDataFrame([(marked.s,)], "text string")).first()
    assert (got.text, got.ca_addition, got.modeling, got.plus_standard) == ("Do it", True, True, True)


def test_walk_clusters(spark):
    lines = ["     Grade 3", "Operations and Thinking   3.OA", "Represent and solve problems.", "1. Interpret products of", "   whole numbers.", "   a. With arrays.", "2. Second.", "", "", "", "1. A footnote that restarts.", "more of it", "Understand properties of", "multiplication.", "3. Third. CA"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    out = segment.walk_clusters(df, ["OA"]).orderBy("line_no").collect()
    assert [(r.code, r.parent_code, r.text) for r in out] == [
        ("3.OA.A.1", None, "Interpret products of whole numbers."), ("3.OA.A.1.a", "3.OA.A.1", "With arrays."), ("3.OA.A.2", None, "Second."), ("3.OA.B.3", None, "Third. CA"),
    ]


def walked(spark, lines, *rest, **options):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    return [(r.code, r.text) for r in segment.walk_clusters(df, *rest, **options).orderBy("line_no").collect()]


def test_walk_goes_on_after_notes_and_strays(spark):
    head = ["     Grade 3", "Operations   3.OA", "Represent and solve.", "1. First one.", "2. Second one."]
    # after a note the walk goes on behind the next page line, not only at the next heading
    note = ["", "", "", "1. A note that restarts.", "   more of it", "12 | Some Framework", "3. Third one.", "   ends here."]
    assert walked(spark, head + note, ["OA"])[-1] == ("3.OA.A.3", "Third one. ends here.")
    # a line at the left edge that is no heading ends the item and is no part of it
    assert walked(spark, [*head, "stray words", "   not continued", "3. Third one."], ["OA"]) == [("3.OA.A.1", "First one."), ("3.OA.A.2", "Second one."), ("3.OA.A.3", "Third one.")]
    # a heading without items takes no letter; one over several lines has its note's number cut off
    got = walked(spark, [*head, "An empty cluster.", "Understand many things", "and more.4", "3. Third one."], ["OA"])
    assert got[-1] == ("3.OA.B.3", "Third one.")
    # a domain of another grade does not count; the grade may come from a page's title
    assert walked(spark, ["   3   Grade 3", *head[1:4], "Operations   4.OA", "2. Still under the first."], ["OA"]) == [("3.OA.A.1", "First one."), ("3.OA.A.2", "Still under the first.")]


def test_walk_of_high_school_categories(spark):
    names = {"A": "Algebra", "F": "Functions"}
    lines = ["  Algebra   A", "Seeing Structure    A-SSE", "Interpret the structure.", "1. Interpret expressions.", "   a. Parts of them.", "Algebra", "2. Use structure.", "Functions", "3. Under no domain.", "Interpreting    F-IF", "Understand functions.", "1. A domain.", "7.1 Graph a root."]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    rows = segment.walk_clusters(df, None, False, names).orderBy("line_no").collect()
    assert [(r.code, r.category, r.category_name, r.grade) for r in rows] == [
        ("A-SSE.A.1", "A", "Algebra", "9-12"), ("A-SSE.A.1.a", "A", "Algebra", "9-12"), ("A-SSE.A.2", "A", "Algebra", "9-12"), ("F-IF.A.1", "F", "Functions", "9-12"), ("F-IF.7.1", "F", "Functions", "9-12"),
    ]


def test_first_code_of_a_set_wins(spark):
    one = spark.createDataFrame([(2, "a"), (1, "a"), (5, None), (3, "b")], "id int, code string")
    two = spark.createDataFrame([(7, "a"), (8, "c")], "id int, code string")
    assert {(r.code, r.id) for r in catalog.merge_record_sets([one.coalesce(1), two]).collect()} == {("a", 2), ("b", 3), ("c", 8)}
    assert {(r.code, r.id) for r in catalog.merge_record_sets([one, two], "id").collect()} == {("a", 1), ("b", 3), ("c", 8)}


def test_empty_page_has_a_total(spark):
    records = spark.createDataFrame([(f"c{i}", i, "t", "B", "K", "") for i in range(7)], "code string, ord int, text string, strand string, grade string, grade_band string")
    records = records.select("*", *(F.lit(None).cast("string").alias(c) for c in ("category", "skill_category_code", "domain", "section", "strand_name", "category_name", "domain_name", "skill_category")), F.lit(False).alias("is_practice"))
    page, total = catalog.browse_records(records, search="c", limit=5, offset=20)
    assert page.count() == 0 and total.first().total == 7


def test_readers_of_whole_files(spark, tmp_path):
    import json

    (tmp_path / "docs").mkdir()
    for name in ("one", "two"):
        doc = {"id": f"i-{name}", "title": name, "sections": [{"title": "s", "objectives": [{"title": "o", "points": 2}]}, {"name": "t"}]}
        (tmp_path / "docs" / f"{name}.json").write_text(json.dumps(doc, indent=2))
    rows = documents.read_documents(spark, f"file://{tmp_path}/docs/*.json").orderBy("doc_id").collect()
    assert [(r.doc_id, r.id, len(r.sections), r.sections[0].objectives[0].points) for r in rows] == [("one", "i-one", 2, 2), ("two", "i-two", 2, 2)]
    final = {"the_id": "x", "the_title": "T", "objectives": [{"path": "p", "alignments": [{"code": "c", "confidence": "high"}]}]}
    (tmp_path / "essay.final.json").write_text(json.dumps(final, indent=2))
    r = documents.read_finals(spark, f"file://{tmp_path}/essay.final.json", "the_id", "the_title").first()
    assert (r.doc_id, r.id, r.title, r.subject, r.objectives[0].alignments[0].code) == ("essay", "x", "T", None, "c")
    (tmp_path / "bare.json").write_text(json.dumps([{"code": "a", "number": 1}, {"code": None}], indent=2))
    (tmp_path / "wrapped.json").write_text(json.dumps({"records": [{"code": "b", "text": "t"}, {"code": "c"}]}, indent=2))
    got = documents.read_taxonomy(spark, {"ela": f"file://{tmp_path}/bare.json", "math": f"file://{tmp_path}/wrapped.json"}).collect()
    assert {(x.subject, x.code) for x in got} == {("ela", "a"), ("math", "b"), ("math", "c")}


def test_anchored_parts(spark):
    def part(text_, why):
        return one(spark, excerpts.anchored(F.col("t"), F.col("w")), t=text_, w=why)

    assert part("Read it, then write 5-7 pages and stop; done", "needs 5-7 pages") == "then write 5-7 pages"
    assert part("Read 3 AND write 12 long pages here", "12") == "write 12 long pages here"
    assert part("Use 12, or more", "12 or 99") is None and part("Write 2 long essays", "none, 9, 2") == "Write 2 long essays"
    assert part("In all, use the Five Paragraphs form", "five paragraphs") == "use the Five Paragraphs form"
    assert part("A five paragraph essay", "a five-paragraph essay") == "A five paragraph essay" and part("nothing", "word count") is None


def test_chunks_that_others_have_all_taken(spark):
    """Where every chunk counts less than nothing the first one stands."""
    s = "doc_id string, path string, ord int, objective_text string, code string, rationale string, text string, source_excerpt string"
    body = "Alpha beta gamma. Delta epsilon zeta."
    rows = [("d", "p", 1, body, "", "", "", "Alpha beta gamma."), ("d", "p", 2, body, "", "", "", "Delta epsilon zeta."), ("d", "p", 3, body, "", "nothing", "", None)]
    got = {r.ord: r.excerpt for r in excerpts.best_excerpt(spark.createDataFrame(rows, s)).collect()}
    assert got[3] == "Alpha beta gamma."


def test_product_names_are_parameters(spark):
    told = "wait until Acme can identify you"
    assert one(spark, rules.counts_toward_coverage(F.lit(""), F.lit(""), "s"), s=told)
    assert not one(spark, rules.counts_toward_coverage(F.lit(""), F.lit(""), "s", product="acme"), s=told)
    assert one(spark, rules.skip_reason(F.lit("t"), "s", F.lit(0.1), product="acme"), s="the Acme intro") == "logistical"


def test_excerpts(spark):
    s = "doc_id string, path string, ord int, objective_text string, code string, rationale string, text string, source_excerpt string"
    body = "Write an introduction here. Cite 2 sources in the essay. Check the grammar."
    rows = [("d", "p", 1, body, "a", "needs 2 sources", "", None), ("d", "p", 2, body, "b", "grammar check", "", None), ("d", "q", 1, "Write 500-1000 words, then stop", "c", "asks for 500-1000 words", "", None), ("d", "q", 2, "Write", "d", "", "", " kept ")]
    got = {(r.path, r.ord): r.excerpt for r in excerpts.best_excerpt(spark.createDataFrame(rows, s)).collect()}
    assert got == {("p", 1): "Cite 2 sources in the essay.", ("p", 2): "Check the grammar.", ("q", 1): "Write 500-1000 words", ("q", 2): "kept"}


def test_patch_keeps_absent_apart_from_null(spark):
    table = spark.createDataFrame([("1", "a", "g", False, 0), ("2", "b", "h", True, 0)], "id string, name string, grade string, is_seed boolean, updated_at int")
    patches = spark.createDataFrame([("1", {"grade": None}, 9), ("2", {"name": "z"}, 9)], "id string, set map<string,string>, updated_at int")
    out = {r.id: r for r in catalog.patch_rows(table, patches, ["name", "grade"]).collect()}
    assert (out["1"].name, out["1"].grade, out["1"].updated_at) == ("a", None, 9) and (out["2"].name, out["2"].updated_at) == ("b", 0)


def test_excerpts_are_scored_once_a_tag(spark):
    """No second reading of the tags and their texts; a missing path is a path, and a number named twice counts twice."""
    s = "doc_id string, path string, ord int, objective_text string, code string, rationale string, text string, source_excerpt string"
    body = "Photosynthesis here now. Take 12 of these there. The third sentence."
    rows = [("d", None, 1, body, "", "photosynthesis, 12 of 12", "", None), ("d", None, 2, body, "", "third", "", None)]
    out = excerpts.best_excerpt(spark.createDataFrame(rows, s))
    assert {r.ord: r.excerpt for r in out.collect()} == {1: "Take 12 of these there.", 2: "The third sentence."}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_nested_records_can_be_compressed(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "ela", [(f"sections[0].objectives[{k}]", None)]) for k in range(20)], "doc_id string, subject string, objectives array<struct<path string, pick string>>")
    documents.write_nested(rows, f"{tmp_path}/plain")
    documents.write_nested(rows, f"{tmp_path}/small", compression="gzip")
    files = [p.name for p in (tmp_path / "small").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    plain, small = (sorted(r.value for r in spark.read.text(f"{tmp_path}/{x}").collect()) for x in ("plain", "small"))
    assert plain == small and len(small) == 20


def test_cards_count_codes_in_one_grouping(spark):
    """Codes of several objectives, in repeated, empty and excluded ones, without a join of two groupings."""
    tag = "array<struct<code string, confidence string>>"
    rows = [
        ("d", "1", 0, True, [("a", "high"), ("b", "low"), ("a", "high")]), ("d", "2", 0, False, [("c", "high")]), ("d", "3", 1, True, [("z", "high")]),
        ("d", "4", 0, True, []), ("d", "5", 0, True, [("", "medium"), (None, "low")]), ("e", "1", 1, True, [("a", "high")]),
    ]
    objectives = spark.createDataFrame(rows, f"doc_id string, path string, section_idx int, counts boolean, tags {tag}")
    out = analytics.document_cards(objectives, spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, section_idx int"))
    assert sorted(map(tuple, out.collect())) == [("d", 3, 2, 3), ("e", 0, 0, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
