"""Curation support: prompts from candidates, validation of answers, retries, costs. Models are called elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import CONFIDENCE_RANKS, first_present
from ..functions.text import parse_json_loose

TOP_N = 5
#: Prices per million tokens, and output tokens expected for an objective.
PRICE_IN, PRICE_OUT, OUTPUT_TOKENS = 3.0, 15.0, 400
MAX_CHARS, RECORD_CHARS, LEAST_CHARS = 280_000, 400, 80
ANSWER = "picks array<struct<code: string, confidence: string, rationale: string>>, note string"


def render_candidates(candidates: Column | str, n: int = TOP_N) -> Column:
    """An array of (code, grade, final_score, text) in rank order as a numbered list; `(none)` if it is empty."""
    cands = F.slice(F.coalesce(F.col(candidates) if isinstance(candidates, str) else candidates), 1, n)

    def line(c: Column, i: Column) -> Column:
        grade = F.when(F.coalesce(c["grade"], F.lit("")) != "", F.concat(F.lit("  [grade "), c["grade"], F.lit("]"))).otherwise("")
        score = F.when(c["final_score"].isNull(), F.lit("?")).otherwise(F.format_string("%.2f", c["final_score"]))
        text = F.trim(F.coalesce(c["text"], F.lit("")))
        body = F.when(text != "", F.concat(F.lit("\n   "), text)).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(c["code"], F.lit("")), F.lit("?")), grade, F.lit("  (score "), score, F.lit(")"), body)

    return F.when(F.coalesce(F.size(cands), F.lit(0)) > 0, F.array_join(F.transform(cands, line), "\n")).otherwise("(none)")


def render_prompt(df: DataFrame, template: str, n: int = TOP_N) -> DataFrame:
    """Adds `prompt`: the template with its eight placeholders filled from the row."""
    values = {
        "doc_title": F.coalesce("doc_title", F.lit("")),
        "doc_description": F.coalesce("doc_description", F.lit("")),
        "subject": F.coalesce(F.nullif("subject", F.lit("")), F.lit("ela")),
        "grades": F.coalesce(F.nullif(F.array_join("grades", ", "), F.lit("")), F.lit("(unknown)")),
        "section_title": F.coalesce("section_title", F.lit("")),
        "objective_title": F.coalesce("objective_title", F.lit("")),
        "objective_description": F.coalesce("objective_description", F.lit("")),
        "candidates": render_candidates("candidates", n),
    }
    prompt = F.lit(template)
    for name, value in values.items():
        prompt = F.replace(prompt, F.lit("{{" + name + "}}"), value)
    return df.withColumn("prompt", prompt)


def allowed_codes(candidates: Column | str, n: int = TOP_N) -> Column:
    """The codes that an answer may use: those of the first n candidates."""
    cands = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.array_distinct(F.array_compact(F.transform(F.slice(cands, 1, n), lambda c: F.nullif(c["code"], F.lit("")))))


def validate_answers(answers: DataFrame, allowed: str = "allowed") -> DataFrame:
    """Parses `answer` and adds `valid`, `picks` and `note`. One code that is not allowed, or one unknown confidence, rejects all of it."""
    parsed = answers.withColumn("a", parse_json_loose("answer", ANSWER))
    picks = F.coalesce("a.picks", F.from_json(F.lit("[]"), "array<struct<code: string, confidence: string, rationale: string>>"))
    good = F.forall(picks, lambda p: F.coalesce(F.array_contains(allowed, p["code"]) & p["confidence"].isin(*CONFIDENCE_RANKS), F.lit(False)))
    clean = F.transform(picks, lambda p: F.struct(p["code"].alias("code"), p["confidence"].alias("confidence"), F.trim(F.coalesce(p["rationale"], F.lit(""))).alias("rationale")))
    ok = F.col("a").isNotNull() & good
    return parsed.withColumn("valid", ok).withColumn("picks", F.when(ok, clean)).withColumn("note", F.when(ok, F.nullif(F.trim("a.note"), F.lit("")))).drop("a")


def resolve_attempts(attempts: DataFrame, keys: tuple[str, ...] = ("doc_id", "path"), tries: int = 2) -> DataFrame:
    """The first valid of the first `tries` answers; where there is none, no picks and a note."""
    row = F.when(F.col("valid"), F.struct("picks", "note"))
    first = attempts.where(F.col("attempt") <= tries).groupBy(*keys).agg(F.min_by(row, F.when(F.col("valid"), F.col("attempt"))).alias("r"), F.count("*").alias("n"))
    failed = F.concat(F.lit("curate failed: no valid answer in "), F.col("n").cast("string"), F.lit(" attempts"))
    return first.select(*keys, F.coalesce("r.picks", F.array().cast(attempts.schema["picks"].dataType)).alias("picks"), F.when(F.col("r").isNull(), failed).otherwise(F.col("r.note")).alias("note"))


def cap_objectives(df: DataFrame, max_per_doc: int, order: tuple[str, ...] = ("section_idx", "objective_idx")) -> DataFrame:
    """The first objectives of each document."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_n") <= max_per_doc).drop("_n")


def estimate_cost(prompts: DataFrame, price_in: float = PRICE_IN, price_out: float = PRICE_OUT, output_tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Per document and, with doc_id null, over all: prompts, tokens in and out, cost. The total sums the documents' rounded costs."""
    each = prompts.groupBy("doc_id").agg(F.count("*").alias("n_objectives"), F.sum(F.greatest(F.lit(1), F.floor(F.length("prompt") / 4))).cast("long").alias("input_tokens"))
    each = each.withColumn("output_tokens", F.col("n_objectives") * output_tokens).withColumn("cost_usd", F.round((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 4))
    total = each.agg(F.lit(None).cast(prompts.schema["doc_id"].dataType).alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_objectives", "input_tokens", "output_tokens")), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    return each.unionByName(total)


def compact_records(records: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """code, grade and text of at most 400 characters; if all records together are larger than `max_chars`, every text shrinks in proportion."""
    slim = records.select(F.col("code"), first_present("grade", "grade_band").alias("grade"), F.substring(F.coalesce("text", F.lit("")), 1, RECORD_CHARS).alias("text"))
    # the size of all as one array: a comma behind each but the last, and two brackets
    size = slim.agg(F.sum(F.length(F.to_json(F.struct("code", "grade", "text"), {"ignoreNullFields": "false"})) + 1) + 1).scalar()
    least = F.greatest(F.lit(LEAST_CHARS), F.floor(F.length("text") * (F.lit(float(max_chars)) / size)).cast("int"))
    return slim.withColumn("text", F.when(size > max_chars, F.substr("text", F.lit(1), least)).otherwise(F.col("text")))


def objective_payload() -> Column:
    """What a prompt tells of an objective, as JSON of six fields; what is missing is null."""
    fields = [first_present("objective_title").alias("title"), "section_title", F.col("objective_description").alias("description"), *(first_present(c).alias(c) for c in ("evaluation_type", "audience"))]
    return F.to_json(F.struct("path", *fields), {"ignoreNullFields": "false"})


def merge_answers(objectives: DataFrame, answers: DataFrame, order: str = "attempt") -> tuple[DataFrame, DataFrame]:
    """(objectives with the tags of their last answer, n_total and n_aligned of each document). Without an answer an objective stays as
    it is. Where an answer has no tags but a reason to skip, the reason, trimmed, is the note; else the old note stays."""
    last = answers.groupBy("doc_id", "path").agg(F.max_by(F.struct(F.col("tags").alias("new_tags"), "skip_reason"), order).alias("a"))
    got = F.col("a").isNotNull()
    tags = F.when(got, F.coalesce("a.new_tags", F.array().cast(objectives.schema["tags"].dataType))).otherwise(F.col("tags"))
    out = objectives.join(last, ["doc_id", "path"], "left").withColumn("_tags", tags)
    reason = F.nullif(F.regexp_replace("a.skip_reason", r"(?U)^\s+|\s+$", ""), F.lit(""))
    note = F.when(got & (F.size("_tags") == 0) & reason.isNotNull(), reason).otherwise(F.col("note"))
    merged = out.withColumn("note", note).withColumn("tags", F.col("_tags")).withColumn("n_tags", F.size("tags")).drop("_tags", "a")
    return merged, merged.groupBy("doc_id").agg(F.count("*").alias("n_total"), F.count_if(F.col("n_tags") > 0).alias("n_aligned"))
