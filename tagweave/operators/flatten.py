"""From nested documents to one row per objective, and the texts that are searched and indexed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import first_present
from ..functions.rules import SUBJECTS, detect_subjects
from ..functions.text import clean_text, preview_text

#: The record fields that are searched, by subject.
INDEX_FIELDS = {
    "ela": ("strand_name", "subgroup", "text"),
    "math": ("category_name", "domain_name", "cluster", "text"),
    "history": ("course_title", "skill_category", "text"),
    "science": ("topic_name", "domain_name", "text", "assessment_boundary"),
}
MIN_QUERY = 40


def flatten_objectives(docs: DataFrame) -> DataFrame:
    """One row per objective of `sections[].objectives[]`, with its two indexes and its path; missing arrays are empty."""
    sections = docs.select("doc_id", clean_text("title").alias("doc_title"), clean_text("description").alias("doc_description"), F.posexplode("sections").alias("section_idx", "s"))
    each = sections.select("doc_id", "doc_title", "doc_description", "section_idx", F.col("s.title").alias("st"), F.col("s.description").alias("sd"), F.posexplode("s.objectives").alias("objective_idx", "o"))
    return each.select(
        "doc_id", "doc_title", "doc_description", "section_idx", "objective_idx",
        F.format_string("sections[%d].objectives[%d]", "section_idx", "objective_idx").alias("path"),
        clean_text("st").alias("section_title"), clean_text("sd").alias("section_description"),
        clean_text("o.title").alias("objective_title"), clean_text("o.description").alias("objective_description"),
        F.col("o.evaluation_type").alias("evaluation_type"), F.col("o.audience").alias("audience"),
    )


def compose_query(objectives: DataFrame) -> DataFrame:
    """Adds `query`: section title, objective title and description; a short one gets the document's title in front."""
    own = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("section_title", "objective_title", "objective_description")))
    return objectives.withColumn("query", F.when((F.length(own) < MIN_QUERY) & (F.coalesce("doc_title", F.lit("")) != ""), F.concat("doc_title", F.lit(". "), own)).otherwise(own))


def compose_index_text(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds `index_text`: the chosen fields, one space between them; missing ones are empty."""
    return records.withColumn("index_text", F.array_join(F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), " "))


def normalize_taxonomy(records: DataFrame) -> DataFrame:
    """Uploaded records with code and text; grade and strand fall back to band, category and domain."""
    return records.where(first_present("code").isNotNull() & first_present("text").isNotNull()).select(
        "code", "text", first_present("grade", "grade_band").alias("grade"), first_present("strand", "category", "domain").alias("strand"),
        first_present("strand_name", "category_name", "domain_name").alias("strand_name"),
    )


def normalize_document(docs: DataFrame) -> DataFrame:
    """Uploaded documents: an objective has its title as label, and as description the preview of its description, else of its title,
    else the label; those with neither go, and then sections without objectives, so that both are numbered anew. A nameless
    section is `Section`, a missing subject `other`; other missing texts are empty."""
    empty = F.lit("")

    def text(*cs: Column) -> Column:
        return F.coalesce(*(F.nullif(c, empty) for c in cs), empty)

    def objective(o: Column) -> Column:
        shown = preview_text(text(o["description"], o["title"]))
        return F.struct(text(o["title"]).alias("title"), text(shown, o["title"]).alias("description"), F.nullif(o["evaluation_type"], empty).alias("evaluation_type"), F.nullif(o["audience"], empty).alias("audience"))

    # previews decode entities outside of array functions: one row an objective on the way, in order
    each = docs.select("doc_id", F.posexplode_outer("sections").alias("si", "s")).select("doc_id", "si", F.coalesce(F.nullif("s.title", empty), F.nullif("s.name", empty), F.lit("Section")).alias("st"), F.posexplode_outer("s.objectives").alias("oi", "o"))
    full = each.where("o is not null").select("doc_id", "si", "st", "oi", objective(F.col("o")).alias("o")).where("o.description <> '' or o.title <> ''")
    sections = full.groupBy("doc_id", "si").agg(F.first("st").alias("st"), F.sort_array(F.collect_list(F.struct("oi", "o"))).alias("os"))
    listed = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("si", "st", "os"))).alias("ss"))
    nested = F.transform("ss", lambda s: F.struct(s["st"].alias("title"), F.transform(s["os"], lambda x: x["o"]).alias("objectives")))
    head = docs.select("doc_id", text(F.col("title"), F.col("name")).alias("title"), preview_text("description").alias("description"), text(F.col("grade"), F.col("grade_band")).alias("grade"), F.lower(F.coalesce(F.nullif("subject", empty), F.lit("other"))).alias("subject"))
    return head.join(listed.select("doc_id", nested.alias("sections")), "doc_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast(_SECTIONS)))


_SECTIONS = "array<struct<title: string, objectives: array<struct<title: string, description: string, evaluation_type: string, audience: string>>>>"


def expand_subjects(docs: DataFrame, mode: str = "auto", text: str = "text") -> DataFrame:
    """One row per document and subject: detected ones, `both` (ela and math), `all`, or the one named."""
    named = {"both": ("ela", "math"), "all": SUBJECTS}.get(mode, (mode,))
    subjects = detect_subjects(text) if mode == "auto" else F.array(*map(F.lit, named))
    return docs.withColumn("subject", F.explode(subjects))
