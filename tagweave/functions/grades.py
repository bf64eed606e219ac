"""Column functions on grades, bands, confidence and the kinds of taxonomy records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence levels as numbers and as ranks.
CONFIDENCE_VALUES = {"high": 90, "medium": 70, "low": 50}
CONFIDENCE_RANKS = {"low": 1, "medium": 2, "high": 3}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def present(col: Column | str) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(_c(col), F.lit(""))


def first_present(*cols: Column | str) -> Column:
    return F.coalesce(*map(present, cols))


def grade_order_key(col: Column | str) -> Column:
    """K first, then by the first number; other names 998, none 999."""
    g = _c(col)
    return (
        F.when(g.isNull() | (g == "") | (g == "unspecified"), 999)
        .when((g == "K") | g.startswith("K-"), 0)
        .otherwise(F.coalesce(F.regexp_extract(g, r"^(\d+)", 1).try_cast("int"), F.lit(998)))
    )


def grade_span(col: Column | str) -> Column:
    """A list of bands as one: from the first one's start to the last one's end."""
    bands = F.filter(F.coalesce(_c(col), F.array().cast("array<string>")), lambda b: b.isNotNull() & (b != ""))
    start = F.split(F.element_at(bands, 1), "-").getItem(0)
    end = F.element_at(F.split(F.element_at(bands, -1), "-"), -1)
    return F.when(F.size(bands) == 0, "").when(F.size(bands) == 1, F.try_element_at(bands, F.lit(1))).when(start == end, F.array_join(bands, ", ")).otherwise(F.concat_ws("-", start, end))


def bucket_of() -> Column:
    """The heading under which a record is counted."""
    named = first_present("strand", "category", "skill_category_code", "domain", "section")
    return F.coalesce(named, F.when(F.coalesce(F.col("is_practice"), F.lit(False)), "MP"), F.lit("Other"))


def display_metadata() -> Column:
    """badge, badge_name, subgroup and grade by kind of record."""
    title = F.coalesce(F.col("course_title"), F.lit(""))
    short = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)
    grade = F.coalesce(first_present("grade", "grade_band"), F.lit(""))
    history = F.col("subject") == "history"
    skill = history & F.coalesce(F.col("is_skill"), F.lit(False))
    practice = F.coalesce(F.col("is_practice"), F.lit(False))
    strand = present("strand").isNotNull()

    def pick(for_skill: Column, for_course: Column, for_strand: Column, for_practice: Column, other: Column) -> Column:
        return F.when(skill, for_skill).when(history, for_course).when(strand, for_strand).when(practice, for_practice).otherwise(other)

    empty = F.lit("")
    category = F.coalesce(F.col("skill_category"), empty)
    return F.struct(
        pick(F.coalesce(present("skill_category_code"), F.lit("HSS")), F.when(title == "Principles of Economics", "Econ").otherwise(F.coalesce(first_present("grade", "grade_band"), F.lit("HSS"))), F.col("strand"), F.lit("MP"), F.coalesce(first_present("category", "domain"), empty)).alias("badge"),
        pick(category, short, F.coalesce(F.col("strand_name"), empty), F.lit("Mathematical Practice"), F.coalesce(first_present("category_name", "domain_name"), empty)).alias("badge_name"),
        pick(category, short, F.coalesce(F.col("subgroup"), empty), empty, F.coalesce(first_present("cluster", "domain_name"), empty)).alias("subgroup"),
        pick(F.coalesce(F.col("grade_band"), empty), F.coalesce(F.col("grade"), empty), grade, empty, grade).alias("grade"),
    )


def _lookup(col: Column | str, values: dict[str, int], other: int) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(_c(col) == k, v) if out is None else out.when(_c(col) == k, v)
    return out.otherwise(other)


def confidence_value(col: Column | str) -> Column:
    return _lookup(col, CONFIDENCE_VALUES, 60)


def confidence_rank(col: Column | str) -> Column:
    """Rank of a level; a missing or unknown one counts as the highest."""
    return _lookup(col, CONFIDENCE_RANKS, 3)
