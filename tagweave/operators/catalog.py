"""Catalog tables: joins with taxonomies, status, browsing, and maintenance of rows and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import bucket_of, first_present
from ..functions.text import preview_text

# joins


def enrich_tags(tags: DataFrame, taxonomy: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("code",)) -> DataFrame:
    """Tags with fields of their record; a tag of an unknown code stays as it is. The taxonomy's codes are unique by key."""
    return tags.join(taxonomy.select(*keys, *fields), list(keys), "left")


def attach_section_titles(objectives: DataFrame, sections: DataFrame) -> DataFrame:
    """section_title by (doc_id, section_idx); `Section N` where there is none."""
    named = sections.select("doc_id", "section_idx", first_present("title").alias("section_title"))
    return objectives.join(named, ["doc_id", "section_idx"], "left").withColumn("section_title", F.coalesce("section_title", F.concat(F.lit("Section "), (F.col("section_idx") + 1).cast("string"))))


def fill_tag_text(tags: DataFrame, taxonomies: DataFrame, order: str = "ord") -> DataFrame:
    """Tags without text get the first non-empty text of their code in the taxonomies' order."""
    texts = taxonomies.where(first_present("text").isNotNull()).groupBy("code").agg(F.min_by("text", order).alias("found"))
    return tags.join(texts, "code", "left").withColumn("text", F.coalesce(first_present("text"), F.col("found"))).drop("found")


def find_by_code(codes: DataFrame, taxonomy: DataFrame, precedence: Column, fields: Sequence[str] = ("text",)) -> DataFrame:
    """The record of each code from the taxonomy of least precedence value."""
    best = taxonomy.groupBy("code").agg(F.min_by(F.struct(*fields), precedence).alias("r"))
    return codes.select("code").distinct().join(best, "code").select("code", *(F.col(f"r.{f}") for f in fields))


def merge_record_sets(sets: Sequence[DataFrame], order: str | None = None) -> DataFrame:
    """All records, of equal codes the first set's, and in a set the first by `order` (else in the order the set is read in); records without code go."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("_set", F.lit(i)).withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("_set", "_at")
    return out.where(first_present("code").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_set", "_at")


def visible_rows(seed: DataFrame, user: DataFrame, hidden: DataFrame) -> DataFrame:
    return seed.join(hidden.select("id"), "id", "left_anti").unionByName(user, allowMissingColumns=True)


def adopted(taxonomies: DataFrame, adoptions: DataFrame) -> DataFrame:
    return taxonomies.join(adoptions.select("id"), "id", "left_semi")


def taxonomy_ids(ids: str = "taxonomy_ids", single: str = "taxonomy_id", default: str = "default_id") -> Column:
    """The ids that hold for a document: its list, else its one id, else the default."""
    listed = F.when(F.size(ids) > 0, F.col(ids))
    return F.coalesce(listed, F.when(first_present(single).isNotNull(), F.array(F.col(single))), F.array(F.col(default)))


def documents_using(docs: DataFrame, taxonomy_id: str) -> DataFrame:
    return docs.where(F.array_contains(taxonomy_ids(), taxonomy_id))


def assign_ranges(pages: DataFrame, ranges: DataFrame, value: str = "page", unit: float = 1.0) -> DataFrame:
    """Rows with each range (lo, hi, both inclusive) that holds their value, as struct `range`; any number of ranges of any lengths.

    A range belongs to the level of its length, level n being 2^n units wide, and lies in at most two bins of that width. So
    ranges and values are joined by (level, bin): a value has one bin for each level that occurs, long ranges are apart from short ones,
    and only ranges that begin or end near a value are compared with it. Null values and ranges with a null or reversed end match nothing."""
    lo, hi, v = F.col("lo").cast("double"), F.col("hi").cast("double"), F.col(value).cast("double")
    level = F.greatest(F.ceil(F.log2(F.greatest((hi - lo) / unit, F.lit(1.0)))).cast("int"), F.lit(0))

    def bin_of(x: Column, level: Column) -> Column:
        return F.floor(x / (F.pow(F.lit(2.0), level) * unit))

    valid = ranges.where(F.col("lo") <= F.col("hi"))
    cut = valid.select(F.struct(*ranges.columns).alias("range"), level.alias("_level"), F.explode(F.array_distinct(F.array(bin_of(lo, level), bin_of(hi, level)))).alias("_bin"))
    levels = valid.agg(F.coalesce(F.sort_array(F.collect_set(level)), F.array().cast("array<int>"))).scalar()
    each = pages.select("*", F.explode(levels).alias("_level")).withColumn("_bin", bin_of(v, F.col("_level")))
    holds = (F.col(value) >= F.col("range.lo")) & (F.col(value) <= F.col("range.hi"))
    return each.join(cut, ["_level", "_bin"]).where(holds).select(*pages.columns, "range")


def nearest_left(value: Column | str, starts: Column | str, slack: float = 0.0) -> Column:
    """Of an array of starts the greatest at most `value + slack`; where none is, the nearest."""
    v, s = (F.col(c) if isinstance(c, str) else c for c in (value, starts))
    left = F.array_max(F.filter(s, lambda x: x <= v + slack))
    nearest = F.array_min(F.transform(s, lambda x: F.struct(F.abs(x - v).alias("d"), x.alias("x"))))["x"]
    return F.coalesce(left, nearest)


def assign_nearest_left(items: DataFrame, starts: DataFrame, value: str, start: str = "start", slack: float = 0.0, keys: Sequence[str] = (), slices: int = 64) -> DataFrame:
    """Items with the greatest start of their key that is at most `value + slack`, else with the nearest; null where the key has no start.

    One ordered pass over items and starts together. So that a key with very many rows is not one task, values are cut at
    quantiles of the items into slices, each ordered by itself: the last start before a slice is carried over from the
    largest of each earlier slice, a table of at most `slices` rows a key. Where no start lies to the left all lie to the right, and
    the nearest is the first. Null values get null, and so do rows with a null key."""
    keys, kind = list(keys), starts.schema[start].dataType
    cuts = [i / slices for i in range(1, slices)] or [0.5]
    bounds = items.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double") + slack, cuts, 1000))).scalar()

    def sliced(df: DataFrame) -> DataFrame:
        """Which slice a place is in: the number of bounds below it."""
        below = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_at"))), F.lit(0))
        return df.withColumn("_bounds", bounds).withColumn("_slice", below).drop("_bounds")

    known = starts.where(" and ".join(f"`{c}` is not null" for c in (start, *keys))).select(*keys, F.col(start).alias("_start"), F.col(start).cast("double").alias("_at"))
    rows = items.select(*keys, F.struct(*items.columns).alias("_item"), F.lit(None).cast(kind).alias("_start"), (F.col(value).cast("double") + slack).alias("_at"))
    both = known.select(*keys, F.lit(None).cast(rows.schema["_item"].dataType).alias("_item"), "_start", "_at").unionByName(rows)
    # with equal places starts come first
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at", F.col("_item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = sliced(both).withColumn("_left", F.last("_start", ignorenulls=True).over(inside)).where("_item is not null")
    per_slice = sliced(known).groupBy(*keys, "_slice").agg(F.min("_start").alias("_lo"), F.max("_start").alias("_hi"))
    firsts = per_slice.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.sort_array(F.collect_list(F.struct("_slice", "_hi"))).alias("_earlier"))
    out = found.join(firsts, keys, "left") if keys else found.join(firsts, how="left")
    carried = F.array_max(F.transform(F.filter("_earlier", lambda e: e["_slice"] < F.col("_slice")), lambda e: e["_hi"]))
    return out.select("_item.*", F.when(F.col(f"_item.{value}").isNotNull(), F.coalesce("_left", carried, "_first")).alias(start))


def assign_range_owner(items: DataFrame, markers: DataFrame, tol: float, keys: Sequence[str], at: str = "y") -> DataFrame:
    """Each item with its last marker at most `at + tol`, by one ordered pass over items and markers of a key."""
    both = markers.select(*keys, (F.col(at) - tol).alias(at), F.col("marker"), F.lit(0).alias("_item"), F.lit(None).cast(items.schema["item"].dataType).alias("item"))
    both = both.unionByName(items.select(*keys, at, F.lit(None).cast(markers.schema["marker"].dataType).alias("marker"), F.lit(1).alias("_item"), "item"))
    w = Window.partitionBy(*keys).orderBy(at, "_item").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("marker", F.last("marker", ignorenulls=True).over(w)).where("_item = 1").drop("_item")


def flag_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `listed`: whether the row's composite key is in a list."""
    known = listed.select(*keys).distinct().withColumn("listed", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


# status and browsing


def document_status(seed: str = "is_seed", aligned: str = "n_aligned", parsed: str = "is_parsed", file: str = "file_name", tagged: str = "is_tagged") -> Column:
    """Struct of alignment (aligned for seeds and where an objective has a tag, else raw), parsing (parsed where a parse is stored,
    else needs_parse with a file and empty without) and tagging (tagged where an alignment is stored, else pending)."""

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    return F.struct(
        F.when(yes(seed) | (F.coalesce(F.col(aligned), F.lit(0)) > 0), "aligned").otherwise("raw").alias("alignment"),
        F.when(yes(parsed), "parsed").when(first_present(file).isNotNull(), "needs_parse").otherwise("empty").alias("parse"),
        F.when(yes(tagged), "tagged").otherwise("pending").alias("tag"),
    )


def _has(query: str, *cols: Column | str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.contains(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(query.strip().lower()))
    return out


#: The subjects that documents can be browsed by.
BROWSED_SUBJECTS = ("ela", "math", "history")


def filter_documents(docs: DataFrame, hide_seeds: bool = False, alignment: str = "all", grade: str = "all", subject: str = "all", search: str = "", subjects: Sequence[str] = BROWSED_SUBJECTS) -> DataFrame:
    """Documents by origin, alignment, grade, subject and words (in name, grade and the preview of the description); rows
    without one of the known `subjects` pass every subject."""
    out = docs
    if hide_seeds:
        out = out.where(~F.coalesce("is_seed", F.lit(False)))
    if alignment != "all":
        aligned = F.coalesce("is_seed", F.lit(False)) | (F.coalesce("n_aligned", F.lit(0)) > 0)
        out = out.where(aligned if alignment == "aligned" else ~aligned)
    if grade != "all":
        out = out.where(F.trim(F.coalesce("grade", F.lit(""))) == grade)
    if subject != "all":
        out = out.where(F.coalesce(~F.col("subject").isin(*subjects), F.lit(True)) | (F.col("subject") == subject))
    return out.where(_has(search, "name", "grade", preview_text("description"))) if search.strip() else out


def filter_taxonomies(taxonomies: DataFrame, hide_library: bool = False, search: str = "") -> DataFrame:
    out = taxonomies.where(F.coalesce(~F.col("is_seed"), F.lit(False))) if hide_library else taxonomies
    return out.where(_has(search, "title", "grade", "subject")) if search.strip() else out


def browse_records(records: DataFrame, search: str = "", bucket: str = "", grade: str = "", used: DataFrame | None = None, limit: int = 50, offset: int = 0, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(one page of the records that pass, one row with the number of all that pass in `total`)."""
    out = records
    if bucket:
        out = out.where(bucket_of() == bucket)
    if grade:
        out = out.where((F.col("grade") == grade) | (F.col("grade_band") == grade))
    if search.strip():
        out = out.where(_has(search, "code", "text", first_present("strand_name", "category_name", "domain_name", "skill_category")))
    if used is not None:
        out = out.join(used.select("code").distinct(), "code", "left_semi")
    return out.orderBy(order).offset(offset).limit(limit), out.agg(F.count("*").alias("total"))


def search_objectives(objectives: DataFrame, q: str, only_aligned: bool = False) -> DataFrame:
    """Objectives where title, description, section title or any tag's code, rationale or text has q."""
    out = objectives.where(F.size("tags") > 0) if only_aligned else objectives
    if not q.strip():
        return out
    return out.where(_has(q, "title", "description", "section_title") | F.exists("tags", lambda t: _has(q, t["code"], t["rationale"], t["text"])))


# maintenance


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows with trimmed strings, empty ones as null, subject in lower case, public unless false."""
    clean = rows.select(*(first_present(F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    if "subject" in rows.columns:
        clean = clean.withColumn("subject", F.lower("subject"))
    if "is_public" in rows.columns:
        clean = clean.withColumn("is_public", F.coalesce("is_public", F.lit(True)))
    return table.unionByName(clean, allowMissingColumns=True)


def patch_rows(table: DataFrame, patches: DataFrame, allowed: Sequence[str], now: Column | str = "updated_at") -> DataFrame:
    """Sets allowed columns from `patches` (id, a map of column to new value in `set`, updated_at). A column that is not in
    the map stays; one that is there with null becomes null. Strings are trimmed, a subject is also put in lower case, and null if
    nothing is left of it. Seeds stay as they are."""

    def value(c: str) -> Column:
        new = F.regexp_replace(F.col("_set")[c], r"(?U)^\s+|\s+$", "")
        return F.nullif(F.lower(new), F.lit("")) if c == "subject" else new

    p = patches.select("id", F.col("set").alias("_set"), F.col(now).alias("_now") if isinstance(now, str) else now.alias("_now"))
    out = table.join(p, "id", "left").withColumn("_on", F.col("_set").isNotNull() & ~F.coalesce("is_seed", F.lit(False)))
    for c in allowed:
        out = out.withColumn(c, F.when(F.col("_on") & F.map_contains_key("_set", c), value(c).cast(table.schema[c].dataType)).otherwise(F.col(c)))
    return out.withColumn("updated_at", F.when(F.col("_on"), F.col("_now")).otherwise(F.col("updated_at"))).select(*table.columns)


def delete_rows(table: DataFrame, ids: DataFrame, *dependent: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(table without the users' rows, ids of seeds to hide, dependent tables without the deleted ids)."""
    gone = table.join(ids.select("id"), "id", "left_semi")
    user = gone.where(~F.coalesce("is_seed", F.lit(False))).select("id")
    return table.join(user, "id", "left_anti"), gone.where(F.coalesce("is_seed", F.lit(False))).select("id"), [d.join(user, "id", "left_anti") for d in dependent]


def toggle_sections(toggles: DataFrame, order: str = "ts") -> DataFrame:
    """Sections whose last toggle excludes them."""
    return toggles.groupBy("doc_id", "section_idx").agg(F.max_by("excluded", order).alias("excluded")).where("excluded").drop("excluded")


def latest_by_key(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last version of each key; aggregates on the map side, so old versions are not moved."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def replace_tags(objectives: DataFrame, changes: DataFrame, taxonomies: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """New tags for some (doc_id, path); tags without code go, n_tags and the document's counts follow, and a tag without text gets
    its code's first non-empty text in the taxonomies (code, text) by their order, else an empty one."""
    new = changes.select("doc_id", "path", F.filter("tags", lambda t: first_present(t["code"]).isNotNull()).alias("_new"))
    if taxonomies is not None:
        fields = new.schema["_new"].dataType.elementType.names
        each = fill_tag_text(new.select("doc_id", "path", F.posexplode("_new").alias("_pos", "t")).select("doc_id", "path", "_pos", "t.*").withColumn("text", F.trim("text")), taxonomies, order)
        tag = F.struct(*(F.coalesce("text", F.lit("")).alias("text") if f == "text" else F.col(f) for f in fields))
        filled = each.groupBy("doc_id", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", tag.alias("t")))), lambda x: x["t"]).alias("_filled"))
        new = new.join(filled, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("_filled", "_new").alias("_new"))
    out = objectives.join(new, ["doc_id", "path"], "left").withColumn("tags", F.coalesce("_new", "tags")).drop("_new").withColumn("n_tags", F.size("tags"))
    w = Window.partitionBy("doc_id")
    return out.withColumn("n_objectives", F.count("*").over(w)).withColumn("n_aligned", F.count_if(F.col("n_tags") > 0).over(w))


def document_detail(docs: DataFrame, parsed: DataFrame, alignments: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Documents with their alignment's objectives, else the parsed ones, the title that the alignment stores, else their taxonomies'
    titles joined by ` + `, counts and statuses. `alignments` may have taxonomy_title, `docs` is_seed and file_name."""
    alignments = alignments if "taxonomy_title" in alignments.columns else alignments.withColumn("taxonomy_title", F.lit(None).cast("string"))
    stored = alignments.select("id", F.col("objectives").alias("_aligned"), F.col("taxonomy_title").alias("_title"), F.lit(True).alias("is_tagged"))
    wide = docs.join(parsed.select("id", F.col("objectives").alias("_parsed"), F.lit(True).alias("is_parsed")), "id", "left").join(stored, "id", "left")
    wide = wide.withColumn("objectives", F.coalesce("_aligned", "_parsed")).withColumn("_ids", taxonomy_ids())
    titles = wide.select("id", F.posexplode("_ids").alias("pos", "taxonomy")).join(taxonomies.select(F.col("id").alias("taxonomy"), "title"), "taxonomy").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("t"))
    out = wide.join(titles, "id", "left").withColumn("taxonomy_title", F.coalesce(first_present("_title"), F.nullif(F.array_join(F.filter(F.transform("t", lambda x: x["title"]), lambda x: x != ""), " + "), F.lit(""))))
    out = out if "is_seed" in out.columns else out.withColumn("is_seed", F.lit(False))
    out = out if "file_name" in out.columns else out.withColumn("file_name", F.lit(None).cast("string"))
    out = out.withColumn("n_objectives", F.coalesce(F.size("objectives"), F.lit(0))).withColumn("n_aligned", F.coalesce(F.size(F.filter("objectives", lambda o: F.size(o["tags"]) > 0)), F.lit(0)))
    return out.withColumn("status", document_status()).drop("_parsed", "_aligned", "_title", "_ids", "t", "is_parsed", "is_tagged")
