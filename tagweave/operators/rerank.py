"""Rule-based reranking of shortlisted candidates, and automatic picks.

Candidates are one row per (doc_id, subject, path, rank) with `score` and the fields of their record; objectives carry
`grades` (inferred), `boosts` and `matched` (rules). Everything up to the window is a projection of the joined row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matcher import matcher, rules_result
from ..functions.rules import ELEMENTARY, infer_grades, skip_reason

KEYS = ("doc_id", "subject", "path")
#: Why an objective has its picks; `{}` is the subject.
REFLECTIVE, LOGISTICAL = "reflective/metacognitive objective, no {} standard applies", "logistical/operational objective, no {} standard applies"
NO_CANDIDATES, PICKED = "no candidates", "top-1 plus any candidate within {:.0%} of top score"
TOP_N, PICK_RATIO, MAX_PICKS = 5, 0.85, 3


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _graded(right: float, kind: Column | None, for_kind: float, wrong: float) -> Column:
    """The grade bonus where grades were inferred."""
    out = F.when(F.array_contains("grades", F.coalesce(F.col("grade"), F.lit("")).cast("string")), right)
    out = out.when(kind, for_kind) if kind is not None else out
    return F.when(F.size("grades") > 0, out.otherwise(wrong)).otherwise(0.0)


def _boosted(key: Column) -> Column:
    return F.coalesce(F.array_contains("boosts", key), F.lit(False))


def ela_bonuses() -> tuple[Column, Column]:
    number = F.regexp_extract("code", r"^[A-Z.]+\.[^.]+\.(\d+)", 1).try_cast("int")
    return _graded(0.25, _yes("is_anchor"), 0.10, -0.15), F.when(number.isNotNull() & _boosted(F.concat_ws(" ", "strand", number.cast("string"))), 0.20).otherwise(0.0)


def math_bonuses() -> tuple[Column, Column]:
    practice = _yes("is_practice")
    return _graded(0.20, practice, 0.10, -0.05), F.when(practice, F.when(_boosted(F.lit("MP")), 0.15).otherwise(0.0)).when(_boosted(F.col("domain_code")), 0.20).otherwise(0.0)


def history_bonuses() -> tuple[Column, Column]:
    skill, code = _yes("is_skill"), F.coalesce(F.col("code"), F.lit(""))
    grade = F.when(skill, 0.05).otherwise(_graded(0.25, None, 0.0, -0.10))
    of_skill = _boosted(F.concat(F.lit("SKILL:"), F.nullif("skill_category_code", F.lit(""))))
    of_content = F.exists("boosts", lambda p: ~p.startswith("SKILL:") & ((code == p) | F.startswith(code, F.concat(p, F.lit("."))) | F.startswith(code, F.concat(p, F.lit(" ")))))
    return grade, F.when(F.when(skill, of_skill).otherwise(of_content), 0.20).otherwise(0.0)


def science_bonuses() -> tuple[Column, Column]:
    band = F.coalesce(F.col("grade").isin("K-2", "3-5"), F.lit(False)) & F.arrays_overlap("grades", F.array(*map(F.lit, ELEMENTARY)))
    topic = F.nullif(F.substring_index("topic", "-", -1), F.lit(""))
    engineering = F.when(_yes("engineering") & _boosted(F.lit("ETS1")), 0.10).otherwise(0.0)
    return _graded(0.20, band, 0.10, -0.05), F.greatest(F.when(_boosted(topic), 0.20).otherwise(0.0), engineering)


BONUSES = {"ela": ela_bonuses, "math": math_bonuses, "history": history_bonuses, "science": science_bonuses}


def _scored(df: DataFrame, grade: Column, keyword: Column) -> DataFrame:
    with_both = df.withColumn("base_score", F.col("score")).withColumn("grade_bonus", grade.cast("double")).withColumn("keyword_bonus", keyword.cast("double"))
    return with_both.withColumn("final_score", F.col("base_score") + F.col("grade_bonus") + F.col("keyword_bonus"))


def rerank_subject(candidates: DataFrame, objectives: DataFrame, subject: str) -> DataFrame:
    """The candidates of one subject with their bonuses and final score."""
    return _scored(candidates.join(objectives, list(KEYS)), *BONUSES[subject]())


def top_reranked(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n best of each objective; ties keep their shortlist rank."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("final_score"), F.asc("rank"))
    return df.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= n)


def rerank_context(subject: str = "subject") -> Column:
    """Section title, objective title and description; history and science have the document's title and description first."""
    own = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("section_title", "objective_title", "objective_description")))
    unit = F.concat_ws(" ", F.nullif("doc_title", F.lit("")), F.nullif("doc_description", F.lit("")))
    return F.when(F.col(subject).isin("history", "science"), F.concat_ws(" ", F.nullif(unit, F.lit("")), F.nullif(own, F.lit("")))).otherwise(own)


def with_rules(objectives: DataFrame) -> DataFrame:
    """Objectives with context, inferred grades, matched rules and boosts."""
    unit = F.concat_ws(" ", F.nullif("doc_title", F.lit("")), F.nullif("doc_description", F.lit("")))
    out = objectives.withColumn("context", rerank_context()).withColumn("grades", infer_grades(unit))
    out = out.withColumn("_numbers", matcher()("context"))
    ela, math, history, science = (rules_result("_numbers", x) for x in ("ela", "math", "history", "science"))
    out = out.withColumn("_rules", F.when(F.col("subject") == "math", math).when(F.col("subject") == "history", history).when(F.col("subject") == "science", science).otherwise(ela))
    return out.withColumn("matched", F.col("_rules.matched")).withColumn("boosts", F.col("_rules.boosts")).drop("_rules", "_numbers")


def rerank(candidates: DataFrame, objectives: DataFrame, n: int = TOP_N) -> DataFrame:
    """All subjects in one pass; an unknown subject counts as ela."""
    return rerank_joined(candidates.join(objectives, list(KEYS)), n)


def rerank_joined(joined: DataFrame, n: int = TOP_N) -> DataFrame:
    """rerank() of candidates that have their objective's columns. Where these come by document, one join of documents before
    subjects are dealt moves each line once; rows that lie by document need no further shuffle here."""
    grade, keyword = (F.when(F.col("subject") == "math", m).when(F.col("subject") == "history", h).when(F.col("subject") == "science", s).otherwise(e) for e, m, h, s in zip(*(BONUSES[x]() for x in ("ela", "math", "history", "science")), strict=True))
    return top_reranked(_scored(joined, grade, keyword), n)


def auto_pick(ranked: DataFrame, objectives: DataFrame, ratio: float = PICK_RATIO, max_picks: int = MAX_PICKS) -> DataFrame:
    """One row per objective (with `objective_title` and `context`): up to `max_picks` of its candidates within `ratio` of the best, and why."""
    best = ranked.groupBy(*KEYS).agg(F.max("final_score").alias("top"), F.sort_array(F.collect_list(F.struct("final_rank", "code", "grade", "final_score", "text"))).alias("all"))
    each = objectives.select(*KEYS, "objective_title", "context").join(best, list(KEYS), "left")
    skipped = skip_reason("objective_title", "context", "top")
    listed = F.coalesce("all", F.array().cast(best.schema["all"].dataType))
    near = F.slice(F.filter(listed, lambda c: skipped.isNull() & (c["final_score"] >= F.round(F.col("top") * ratio, 12))), 1, max_picks)
    picks = F.transform(near, lambda c: F.struct(c["code"].alias("code"), c["grade"].alias("grade"), F.round(c["final_score"], 3).alias("final_score"), c["text"].alias("text")))

    def told(reason: str) -> Column:
        return F.concat_ws("", *(F.upper("subject") if part is None else F.lit(part) for part in _around(reason)))

    reason = F.when(skipped == "reflective", told(REFLECTIVE)).when(skipped == "logistical", told(LOGISTICAL)).when(F.col("top").isNull(), NO_CANDIDATES).otherwise(PICKED.format(ratio))
    return each.select(*KEYS, picks.alias("picks"), reason.alias("reason"), "top")


def _around(reason: str) -> tuple[str, None, str]:
    before, after = reason.split("{}")
    return before, None, after
