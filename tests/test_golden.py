"""Golden numbers over reviewed documents, and reranked candidates of one of them."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagweave.functions import rules
from tagweave.operators import analytics, evaluate, rerank

FIXTURES = Path(__file__).parent / "fixtures"
REVIEWED = json.loads((FIXTURES / "reviewed.json").read_text())
RERANKED = json.loads((FIXTURES / "reranked.json").read_text())
TAG = "struct<code string, confidence string, rationale string, text string>"


def tag(told):
    return (*told.split(), "", "")


@pytest.fixture(scope="module")
def objectives(spark):
    rows = [(d["id"], o["path"], [tag(t) for t in o["tags"]]) for d in REVIEWED for o in d["objectives"]]
    return spark.createDataFrame(rows, f"doc_id string, path string, tags array<{TAG}>")


def test_summaries(spark, objectives):
    docs = spark.createDataFrame([(d["id"], d["subject"]) for d in REVIEWED], "doc_id string, subject string")
    r = analytics.global_summary(objectives, docs).first()
    assert (r.n_objectives, r.n_aligned, r.pct_aligned, r.n_assignments, r.n_codes) == (94, 64, 68.1, 128, 37)
    assert (r.high, r.medium, r.low) == (77, 39, 12) and {x.subject: x.n for x in r.by_subject} == {"ela": 4, "math": 2}
    got = {r.doc_id: r for r in analytics.document_summary(objectives).collect()}
    want = {"wwii_data": (13, 9, 20, 10), "budget": (27, 15, 27, 12), "mockingbird_essay": (6, 5, 11, 10), "odyssey_essay": (13, 11, 20, 12), "resume": (18, 10, 25, 12), "romeo_essay": (17, 14, 25, 11)}
    assert {d: (r.n_objectives, r.n_aligned, r.n_assignments, len(r.codes)) for d, r in got.items()} == want
    for d in REVIEWED:
        codes = [t.split()[0] for o in d["objectives"] for t in o["tags"]]
        assert {c.code: c.n for c in got[d["id"]].code_counts} == {c: codes.count(c) for c in set(codes)}


def test_picks_against_reviewed_tags(spark, objectives):
    picked = [(RERANKED["id"], o["path"], [(c, "high", "", "") for c in o["picks"]]) for o in RERANKED["objectives"]]
    predicted = evaluate.code_sets(spark.createDataFrame(picked, f"doc_id string, path string, tags array<{TAG}>"))
    truth = evaluate.code_sets(objectives.where(F.col("doc_id") == RERANKED["id"]))
    r = evaluate.precision_recall_f1(evaluate.compare_code_sets(evaluate.pair_objectives(predicted, truth))).where("doc_id is null").first()
    assert (r.tp, r.fp, r.fn) == (1, 13, 10)


def test_reranked_candidates(spark):
    """The bonuses, scores, order and picks of all thirty candidates, from the texts of their objectives."""
    cands, objs = [], []
    for o in RERANKED["objectives"]:
        by_score = sorted(o["candidates"], key=lambda c: -c["score"])
        cands += [("d", "ela", o["path"], i, c["score"], c["code"], c["strand"], c["grade"], c["is_anchor"], "t") for i, c in enumerate(by_score, 1)]
        objs.append(("d", "ela", o["path"], o["section_title"], o["objective_title"], o["objective_description"], RERANKED["grades"]))
    none = [F.lit(None).cast("boolean").alias(c) for c in ("is_practice", "is_skill", "engineering")] + [F.lit(None).cast("string").alias(c) for c in ("domain_code", "skill_category_code", "topic")]
    c = spark.createDataFrame(cands, "doc_id string, subject string, path string, rank int, score double, code string, strand string, grade string, is_anchor boolean, text string").select("*", *none)
    o = spark.createDataFrame(objs, "doc_id string, subject string, path string, section_title string, objective_title string, objective_description string, grades array<string>")
    o = o.withColumn("doc_title", F.lit(None).cast("string")).withColumn("doc_description", F.lit(None).cast("string")).withColumn("context", rerank.rerank_context())
    m = o.withColumn("m", rules.match_rules_of("context")).select("*", "m.matched", "m.boosts").drop("m")
    matched = {r.path: len(r.matched) for r in m.collect()}
    ranked = rerank.rerank(c, m.drop("matched"))
    got = {}
    for r in ranked.collect():
        got.setdefault(r.path, {})[r.final_rank] = (r.code, r.grade_bonus, r.keyword_bonus, round(r.final_score, 9))
    picks = {r.path: ([p.code for p in r.picks], r.reason) for r in rerank.auto_pick(ranked, m).collect()}
    for x in RERANKED["objectives"]:
        want = {i: (c["code"], c["grade_bonus"], c["keyword_bonus"], round(c["final_score"], 9)) for i, c in enumerate(x["candidates"], 1)}
        assert got[x["path"]] == want and matched[x["path"]] == x["rules"]
        assert picks[x["path"]] == (x["picks"], x["reason"])
