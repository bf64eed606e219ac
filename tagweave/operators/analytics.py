"""Coverage, confidence, top codes and usage; ordered limits, shares and clusters.

Tags are one row each: doc_id, path, code, confidence. Objectives are one row each with `tags`, an array of such structs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import bucket_of, first_present, grade_order_key

LEVELS = ("high", "medium", "low")


def tags_of(objectives: DataFrame, *keep: str) -> DataFrame:
    """One row per tag of each objective."""
    return objectives.select("doc_id", "path", *keep, F.explode("tags").alias("t")).select("doc_id", "path", *keep, "t.*")


def _confidence_counts() -> list[Column]:
    def count(level: str) -> Column:
        return F.sum(F.size(F.filter("tags", lambda t: t["confidence"] == level))).alias(level)

    return [count(level) for level in LEVELS]


def document_summary(objectives: DataFrame) -> DataFrame:
    """Per document: objectives, aligned ones, assignments, sorted distinct codes with their counts, and counts by confidence."""
    out = objectives.groupBy("doc_id").agg(
        F.count("*").alias("n_objectives"),
        F.count_if(F.size("tags") > 0).alias("n_aligned"),
        F.sum(F.size("tags")).alias("n_assignments"),
        *_confidence_counts(),
    )
    counts = code_counts(tags_of(objectives), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("code_counts"))
    joined = out.join(counts, "doc_id", "left").withColumn("code_counts", F.coalesce("code_counts", F.array().cast(counts.schema["code_counts"].dataType)))
    return joined.withColumn("codes", F.transform("code_counts", lambda c: c["code"]))


def code_counts(tags: DataFrame, *keys: str) -> DataFrame:
    return tags.groupBy(*keys, "code").agg(F.count("*").alias("n"))


def _coverage(df: DataFrame, counted: Column, half_even: bool) -> DataFrame:
    aligned = F.count_if(counted & (F.size("tags") > 0))
    total = F.count_if(counted)
    rounded = F.bround if half_even else F.round
    pct = F.when(total > 0, rounded(100.0 * aligned / total, 1)).otherwise(0.0)
    return df.agg(total.alias("n_objectives"), aligned.alias("n_aligned"), pct.alias("pct_aligned"), F.sum(F.size("tags")).alias("n_assignments"), *_confidence_counts())


def global_summary(objectives: DataFrame, docs: DataFrame) -> DataFrame:
    """One row over all documents, with their number by subject; distinct codes are counted apart, by code, so that no task holds them all."""
    codes = tags_of(objectives).agg(F.count_distinct("code")).scalar()
    subjects = by_subject(docs).agg(F.sort_array(F.collect_list(F.struct("subject", "n")))).scalar()
    return _coverage(objectives, F.lit(True), True).withColumn("n_codes", codes).withColumn("by_subject", subjects)


def by_subject(docs: DataFrame) -> DataFrame:
    """Documents by subject; a missing subject is ela."""
    return docs.groupBy(F.coalesce(first_present("subject"), F.lit("ela")).alias("subject")).agg(F.count("*").alias("n"))


def without_excluded(objectives: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Objectives outside excluded sections."""
    return objectives.join(exclusions.select("doc_id", "section_idx").distinct(), ["doc_id", "section_idx"], "left_anti")


def coverage_summary(objectives: DataFrame, exclusions: DataFrame) -> DataFrame:
    """As global_summary() without excluded sections; `counts` decides what coverage is over, not what codes and confidence are counted over; halves round up."""
    kept = without_excluded(objectives, exclusions)
    codes = tags_of(kept).agg(F.count_distinct("code")).scalar()
    return _coverage(kept, F.col("counts"), False).withColumn("n_codes", codes)


def _each_document(objectives: DataFrame, exclusions: DataFrame, docs: DataFrame | None) -> DataFrame:
    """One row per document with counts over its included objectives; documents whose sections are all excluded, and those of `docs` without objectives, count 0.

    Coverage and confidence are over objectives that count, codes over all included ones."""
    out = exclusions.select("doc_id", "section_idx").distinct().withColumn("_out", F.lit(True))
    marked = objectives.join(out, ["doc_id", "section_idx"], "left").withColumn("_in", F.col("_out").isNull())
    counted, tagged = F.col("_in") & F.col("counts"), F.size("tags") > 0

    def level(name: str) -> Column:
        return F.when(counted, F.size(F.filter("tags", lambda t: t["confidence"] == name))).otherwise(0)

    # a row for each code; the objective's own counts stand in the first, so that one grouping gives both
    codes = F.when(F.col("_in"), F.filter(F.transform("tags", lambda t: t["code"]), lambda c: F.coalesce(c, F.lit("")) != ""))
    own = {"n_objectives": F.when(counted, 1).otherwise(0), "n_aligned": F.when(counted & tagged, 1).otherwise(0), **{name: level(name) for name in LEVELS}}
    rows = marked.select("doc_id", *(c.alias(n) for n, c in own.items()), F.posexplode_outer(codes).alias("_pos", "code"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    counts = [F.sum(F.when(first, F.col(n))).alias(n) for n in own]
    each = rows.groupBy("doc_id").agg(*counts, F.size(F.collect_set("code")).cast("long").alias("n_codes"))
    if docs is None:
        return each
    return docs.select("doc_id").distinct().join(each, "doc_id", "left").na.fill(0)


def document_cards(objectives: DataFrame, exclusions: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Coverage and distinct codes of each document (of `docs`, else of those with objectives) after exclusions."""
    return _each_document(objectives, exclusions, docs).select("doc_id", "n_objectives", "n_aligned", "n_codes")


def alignment_report(objectives: DataFrame, exclusions: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Confidence mix and coverage of each document over included objectives that count; coverage is 0 where there are none, and halves round up."""
    out = _each_document(objectives, exclusions, docs).drop("n_codes")
    pct = F.when(F.col("n_objectives") > 0, F.floor(100.0 * F.col("n_aligned") / F.col("n_objectives") + 0.5)).otherwise(0)
    return out.withColumn("pct_aligned", pct.cast("long"))


def taxonomy_summary(records: DataFrame) -> DataFrame:
    """Records by bucket and by grade, in one grouping; see summary_order()."""
    named = records.select(bucket_of().alias("bucket"), F.coalesce(first_present("grade", "grade_band"), F.lit("unspecified")).alias("grade"))
    out = named.groupingSets([["bucket"], ["grade"]], "bucket", "grade").agg(F.grouping("bucket").alias("by_grade"), F.count("*").alias("n"))
    return out.select(F.when(F.col("by_grade") == 1, "grade").otherwise("bucket").alias("kind"), F.when(F.col("by_grade") == 1, F.col("grade")).otherwise(F.col("bucket")).alias("name"), "n")


def summary_order() -> list[Column]:
    """Buckets, most records first, then grades in their order."""
    bucket = F.col("kind") == "bucket"
    return [F.when(bucket, 0).otherwise(1), F.desc(F.when(bucket, F.col("n"))), F.when(~bucket, grade_order_key("name")), F.col("name")]


def _tags_in_use(tags: DataFrame, exclusions: DataFrame | None, docs: DataFrame | None) -> DataFrame:
    """Tags with a code, outside excluded sections, of the documents given."""
    out = tags.where(first_present("code").isNotNull())
    out = out if exclusions is None else without_excluded(out, exclusions)
    return out if docs is None else out.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def usage_index(tags: DataFrame, exclusions: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(code, doc_id) pairs in use, in long form: a code that very many documents use makes no large row.

    `exclusions` are (doc_id, section_idx), and tags have section_idx then; `docs` are the documents under a taxonomy, see documents_using()."""
    return _tags_in_use(tags, exclusions, docs).select("code", "doc_id").distinct()


def used_records(tags: DataFrame, records: DataFrame, exclusions: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Records of a taxonomy whose code is in use by the documents under it."""
    return records.join(_tags_in_use(tags, exclusions, docs).select("code").distinct(), "code", "left_semi")


def record_counts(records: DataFrame, keys: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Counts by each key apart, null as "null", and of set flags."""
    each = [F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("null")).alias("value")) for k in keys]
    marked = [F.when(F.col(f), F.struct(F.lit(f).alias("key"), F.lit("true").alias("value"))) for f in flags]
    return records.select(F.explode(F.array_compact(F.array(*each, *marked))).alias("e")).groupBy("e.key", "e.value").agg(F.count("*").alias("n"))


def shares(df: DataFrame, count: str = "n", digits: int = 6) -> DataFrame:
    """Adds each row's share of the sum of a small table."""
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn("share", F.round(F.col(count) / total, digits))


def relative_to_max(df: DataFrame, count: str = "n", digits: int = 6) -> DataFrame:
    most = df.agg(F.max(count)).scalar()
    return df.withColumn("relative", F.round(100.0 * F.col(count) / most, digits))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct present values in grade order."""
    return df.select(first_present(col).alias(col)).where(F.col(col).isNotNull()).distinct().orderBy(*distinct_order(col))


def distinct_order(col: str) -> list[Column]:
    return [grade_order_key(col), F.col(col)]


def top_codes(tags: DataFrame, k: int = 15) -> DataFrame:
    return code_counts(tags).orderBy(F.desc("n"), F.asc("code")).limit(k)


def subject_title_order() -> list[Column]:
    """ela, math, history, then others; then by lower-case title."""
    place = F.coalesce(F.element_at(F.create_map(F.lit("ela"), F.lit(0), F.lit("math"), F.lit(1), F.lit("history"), F.lit(2)), F.col("subject")), F.lit(3))
    return [place, F.lower("title")]


def sort_by_subject_title(docs: DataFrame) -> DataFrame:
    return docs.orderBy(*subject_title_order())


def catalog_order(mode: str = "recent", title: str = "name", missing_is_seed: bool = False) -> list[Column]:
    """`recent`: users' rows first, newest first; `name`; `aligned`: by share of aligned objectives.

    Documents have a name, and count as users' where is_seed is missing; taxonomies have a title, and count as seeds there."""
    if mode == "name":
        return [F.lower(F.coalesce(title, F.lit("")))]
    if mode == "aligned":
        return [F.desc(F.when(F.col("n_objectives") > 0, F.col("n_aligned") / F.col("n_objectives")).otherwise(0.0))]
    return [F.coalesce("is_seed", F.lit(missing_is_seed)), F.desc_nulls_last("created_at")]


def sort_catalog(rows: DataFrame, mode: str = "recent", title: str = "name", missing_is_seed: bool = False) -> DataFrame:
    return rows.orderBy(*catalog_order(mode, title, missing_is_seed))


#: Grades of science records in the order of their lists; others come last.
SCIENCE_GRADES = ("K", "K-2", "1", "2", "3", "4", "3-5", "5", "MS", "HS")


def science_grade_order() -> list[Column]:
    """By grade, then topic and number."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SCIENCE_GRADES)), F.col("grade")), F.lit(0)), F.lit(len(SCIENCE_GRADES) + 1))
    return [place, F.col("topic"), F.col("number")]


def sort_by_grade(records: DataFrame) -> DataFrame:
    return records.orderBy(*science_grade_order())


def with_position(df: DataFrame, order: Sequence[Column | str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds `position`, from 1, in an order that should be total. Rows are sorted by ranges and stored; a row's place in its range and
    the sizes of the ranges before it give its position, so no task holds more than a range."""
    placed = store(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(before, "_part").withColumn("position", F.col("_before") + at + 1).select(*df.columns, "position")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; null keys are equal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def consecutive_runs(df: DataFrame, col: str, order: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds `run`: a new number whenever the value changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(F.struct(col)).over(w).isNull() | ~F.col(col).eqNullSafe(F.lag(col).over(w)), 1).otherwise(0)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w)).drop("_new")


def cluster_1d(df: DataFrame, col: str, tol: float, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Clusters of sorted values with gaps under `tol`: their size, ends and mean."""
    w = Window.partitionBy(*keys).orderBy(col)
    gap = F.when(F.col(col) - F.lag(col).over(w) >= tol, 1).otherwise(0)
    return df.withColumn("_new", gap).withColumn("cluster", F.sum("_new").over(w)).groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("center"))


def cluster_letters(df: DataFrame, keys: Sequence[str] = ("domain",), cluster: str = "cluster", order: str = "line_no") -> DataFrame:
    """A letter for each cluster of a domain in order of first appearance."""
    first = df.groupBy(*keys, cluster).agg(F.min(order).alias("first"))
    return first.withColumn("letter", F.char(F.dense_rank().over(Window.partitionBy(*keys).orderBy("first")) + 64))
