"""Queries of aggregations, joins, ordered operations and table maintenance (A, J, W, F10-F15, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grades import confidence_rank
from ..operators import analytics as A
from ..operators import catalog as C
from ..operators import evaluate as E
from .base import EXCLUSIONS, KEPT, OBJECTIVES, RECORDS, TAGS, exclusions, objectives, query, records, table, tags
from .shared import stored


@query("a1_document_summary", f"""with {TAGS}, {OBJECTIVES}, n as (select doc_id, code, count(*) as n from tags group by all), c as (select doc_id, string_agg(code, ',' order by code) as codes, string_agg(code || ':' || n, ',' order by code) as code_counts from n group by 1)
    select doc_id, coalesce(any_value(code_counts), '') as code_counts, count(*) as n_objectives, count(*) filter (where n_tags > 0) as n_aligned, cast(sum(n_tags) as bigint) as n_assignments, coalesce(any_value(codes), '') as codes,
    cast(sum(high) as bigint) as high, cast(sum(medium) as bigint) as medium, cast(sum(low) as bigint) as low from objs left join c using (doc_id) group by 1""")
def a1(s, d):
    told = F.transform("code_counts", lambda c: F.concat_ws(":", c["code"], c["n"].cast("string")))
    return A.document_summary(objectives(s, d)).withColumn("codes", F.array_join("codes", ",")).withColumn("code_counts", F.array_join(told, ","))


@query("a2_global_summary", f"""with {TAGS}, {OBJECTIVES} select count(*) as n_objectives, count(*) filter (where n_tags > 0) as n_aligned,
    round_even(100.0 * count(*) filter (where n_tags > 0) / count(*), 1) as pct_aligned, cast(sum(n_tags) as bigint) as n_assignments, cast(sum(high) as bigint) as high,
    cast(sum(medium) as bigint) as medium, cast(sum(low) as bigint) as low, (select count(distinct code) from tags) as n_codes,
    (select string_agg(subject || ':' || n, ',' order by subject) from (select case o_orderkey % 5 when 1 then 'math' when 2 then 'history' else 'ela' end as subject, count(*) as n from orders group by 1)) as by_subject from objs""")
def a2(s, d):
    k = F.col("o_orderkey") % 5
    docs = table(s, d, "orders").select(F.when(k == 1, "math").when(k == 2, "history").when(k == 3, "").alias("subject"))
    told = F.transform("by_subject", lambda c: F.concat_ws(":", c["subject"], c["n"].cast("string")))
    return A.global_summary(objectives(s, d), docs).withColumn("by_subject", F.array_join(told, ","))


@query("a3_coverage_summary", f"""with {TAGS}, {OBJECTIVES}, {EXCLUSIONS}, {KEPT} select count(*) filter (where counts) as n_objectives, count(*) filter (where counts and n_tags > 0) as n_aligned,
    round(100.0 * count(*) filter (where counts and n_tags > 0) / count(*) filter (where counts), 1) as pct_aligned, cast(sum(n_tags) as bigint) as n_assignments, cast(sum(high) as bigint) as high,
    cast(sum(medium) as bigint) as medium, cast(sum(low) as bigint) as low, (select count(distinct code) from kept_tags) as n_codes from kept""")
def a3(s, d):
    return A.coverage_summary(objectives(s, d), exclusions(s, d))


# every document that has objectives, with zeros where all its sections are excluded
_REPORTED = "d as (select distinct doc_id from objs), k as (select doc_id, count(*) filter (where counts) as n_objectives, count(*) filter (where counts and n_tags > 0) as n_aligned, sum(high) filter (where counts) as high, sum(medium) filter (where counts) as medium, sum(low) filter (where counts) as low from kept group by 1)"


@query("a4_document_cards", f"""with {TAGS}, {OBJECTIVES}, {EXCLUSIONS}, {KEPT}, {_REPORTED}, c as (select doc_id, count(distinct code) as n_codes from kept_tags group by 1)
    select doc_id, coalesce(n_objectives, 0) as n_objectives, coalesce(n_aligned, 0) as n_aligned, coalesce(n_codes, 0) as n_codes from d left join k using (doc_id) left join c using (doc_id)""")
def a4(s, d):
    return A.document_cards(objectives(s, d), exclusions(s, d))


@query("a5_alignment_report", f"""with {TAGS}, {OBJECTIVES}, {EXCLUSIONS}, {KEPT}, {_REPORTED}, o as (select o_orderkey as doc_id from orders)
    select doc_id, coalesce(n_objectives, 0) as n_objectives, coalesce(n_aligned, 0) as n_aligned, cast(coalesce(high, 0) as bigint) as high, cast(coalesce(medium, 0) as bigint) as medium, cast(coalesce(low, 0) as bigint) as low,
    cast(case when n_objectives > 0 then floor(100.0 * n_aligned / n_objectives + 0.5) else 0 end as bigint) as pct_aligned from o left join k using (doc_id)""")
def a5(s, d):
    """All orders, those without lines too."""
    return A.alignment_report(objectives(s, d), exclusions(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")))


@query("a6_taxonomy_summary", f"""with {RECORDS}, n as (select coalesce(nullif(strand, ''), category, case when is_practice then 'MP' else 'Other' end) as bucket, coalesce(nullif(grade, ''), grade_band) as grade from recs),
    b as (select 'bucket' as kind, bucket as name, count(*) as n, row_number() over (order by count(*) desc, bucket) as position from n group by 2),
    g as (select 'grade' as kind, grade as name, count(*) as n from n group by 2), o as (select *, case when name like 'K%' then 0 else coalesce(try_cast(nullif(regexp_extract(name, '^(\\d+)', 1), '') as integer), 998) end as key from g)
    select kind, name, n, position from b union all select kind, name, n, (select count(*) from b) + row_number() over (order by key, name) from o""")
def a6(s, d):
    return A.with_position(A.taxonomy_summary(records(s, d)), A.summary_order(), stored)


_KEPT_TAGS = "kept_tags as (select * from tags anti join excl using (doc_id, section_idx))"
# orders use one of ten taxonomies
_UNDER = "u as (select o_orderkey as doc_id from orders where o_custkey % 10 = 3)"


def _under(s, d):
    return table(s, d, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("doc_id"))


@query("a7_usage_index", f"with {TAGS}, {EXCLUSIONS}, {_KEPT_TAGS} select distinct code, doc_id from kept_tags")
def a7(s, d):
    return A.usage_index(tags(s, d), exclusions(s, d))


@query("a7_usage_under_taxonomy", f"with {TAGS}, {EXCLUSIONS}, {_UNDER}, {_KEPT_TAGS} select distinct code, doc_id from kept_tags semi join u using (doc_id)")
def a7_under(s, d):
    return A.usage_index(tags(s, d), exclusions(s, d), _under(s, d))


@query("a8_used_records", f"with {TAGS}, {EXCLUSIONS}, {_UNDER}, {RECORDS}, {_KEPT_TAGS} select code, ord, text, grade from recs where ord % 2 = 0 and code in (select code from kept_tags semi join u using (doc_id))")
def a8(s, d):
    return A.used_records(tags(s, d), records(s, d).where("ord % 2 = 0"), exclusions(s, d), _under(s, d)).select("code", "ord", "text", "grade")


_PAIRS = """p as (select l_orderkey as doc_id, cast(l_linenumber as varchar) as path, list_distinct(list('C' || (l_partkey % 50))) as c from lineitem where l_discount <= 0.06 group by all),
    t as (select l_orderkey as doc_id, cast(l_linenumber as varchar) as path, list_distinct(list('C' || (l_partkey % 50))) as c from lineitem where l_discount >= 0.04 group by all),
    pairs as (select doc_id, path, coalesce(p.c, []) as predicted, coalesce(t.c, []) as truth from p full join t using (doc_id, path)),
    cmp as (select doc_id, path, list_sort(list_intersect(predicted, truth)) as common, list_sort(list_filter(predicted, lambda x: not list_contains(truth, x))) as only_predicted,
    list_sort(list_filter(truth, lambda x: not list_contains(predicted, x))) as only_truth from pairs)"""


def _pairs(s, d):
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("path"), F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("code"), F.lit("high").alias("confidence"), "l_discount")

    def side(rows):
        one = rows.groupBy("doc_id", "path").agg(F.collect_list(F.struct("code", "confidence")).alias("tags"))
        return E.code_sets(one)

    return E.pair_objectives(side(line.where("l_discount <= 0.06")), side(line.where("l_discount >= 0.04")))


@query("j8_pair_objectives", f"with {_PAIRS} select doc_id, path, array_to_string(list_sort(predicted), ',') as predicted, array_to_string(list_sort(truth), ',') as truth from pairs")
def j8(s, d):
    return _pairs(s, d).select("doc_id", "path", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("predicted", "truth")))


@query("j9_pair_documents", "with p as (select distinct l_orderkey as doc_id from lineitem where l_discount <= 0.03), t as (select distinct l_orderkey as doc_id from lineitem where l_discount >= 0.06) select doc_id, case when p.doc_id is null then 'truth_only' when t.doc_id is null then 'predicted_only' else 'both' end as side from p full join t using (doc_id)")
def j9(s, d):
    line = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return E.pair_documents(line.where("l_discount <= 0.03"), line.where("l_discount >= 0.06"))


@query("a9_compare_code_sets", f"with {_PAIRS} select doc_id, path, array_to_string(common, ',') as common, array_to_string(only_predicted, ',') as only_predicted, array_to_string(only_truth, ',') as only_truth, len(only_predicted) = 0 and len(only_truth) = 0 as exact from cmp")
def a9(s, d):
    out = E.compare_code_sets(_pairs(s, d))
    return out.select("doc_id", "path", *(F.array_join(c, ",").alias(c) for c in ("common", "only_predicted", "only_truth")), "exact")


@query("a10_precision_recall_f1", f"""with {_PAIRS}, s as (select doc_id, count(*) as n_objectives, count(*) filter (where len(only_predicted) = 0 and len(only_truth) = 0) as n_exact,
    cast(sum(len(common)) as bigint) as tp, cast(sum(len(only_predicted)) as bigint) as fp, cast(sum(len(only_truth)) as bigint) as fn from cmp group by rollup (doc_id)),
    r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as q from s)
    select doc_id, n_objectives, n_exact, tp, fp, fn, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0.0 end, 6) as f1, round(100.0 * n_exact / n_objectives, 6) as exact_pct from r""")
def a10(s, d):
    out = E.precision_recall_f1(E.compare_code_sets(_pairs(s, d)))
    return out.select(*out.columns[:6], *(F.round(c, 6).alias(c) for c in out.columns[6:]))


@query("a11_record_counts", "select 'p_type' as key, coalesce(p_type, 'null') as value, count(*) as n from part group by all union all select 'p_brand', coalesce(p_brand, 'null'), count(*) from part group by all union all select 'large', 'true', count(*) from part where p_size > 25")
def a11(s, d):
    return A.record_counts(table(s, d, "part").withColumn("large", F.col("p_size") > 25), ["p_type", "p_brand"], ["large"])


@query("a12_shares", f"with {TAGS}, c as (select confidence, count(*) as n from tags group by 1) select confidence, n, round(n / (select sum(n) from c), 6) as share, round(100.0 * n / (select max(n) from c), 6) as relative from c")
def a12(s, d):
    return A.relative_to_max(A.shares(tags(s, d).groupBy("confidence").agg(F.count("*").alias("n"))))


_GRADE_KEY = "case when grade is null or grade = '' then 999 when grade = 'K' or grade like 'K-%' then 0 else coalesce(try_cast(nullif(regexp_extract(grade, '^(\\d+)', 1), '') as integer), 998) end"


@query("a13_distinct_sorted", f"with {RECORDS}, g as (select distinct grade from recs where grade <> '') select grade, row_number() over (order by {_GRADE_KEY}, grade) as position from g")
def a13(s, d):
    return A.with_position(A.distinct_sorted(records(s, d), "grade"), A.distinct_order("grade"), stored)


@query("w1_top_codes", f"with {TAGS} select code, count(*) as n from tags group by 1 order by n desc, code limit 15")
def w1(s, d):
    return A.top_codes(tags(s, d))


_CATALOG = """cat as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'ela' when 1 then 'math' when 2 then 'history' when 3 then 'science' else null end as subject, 'Order ' || o_custkey as name,
    o_orderdate as created_at, o_orderstatus = 'F' as is_seed, o_orderkey % 4 as n_aligned, o_orderkey % 6 as n_objectives, case when o_orderkey % 2 = 0 then 'f.json' else '' end as file_name, o_orderkey % 6 > 1 as is_parsed, o_orderkey % 4 > 1 as is_tagged, case when o_orderkey % 3 = 0 then ' 9-10 ' else 'K' end as grade, '<p>' || o_orderpriority || '</p>' || repeat('x', 215) || '7' as description from orders)"""


def _catalog(s, d):
    k = F.col("o_orderkey") % 5
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "ela").when(k == 1, "math").when(k == 2, "history").when(k == 3, "science").alias("subject"), F.concat(F.lit("Order "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("is_seed"), (F.col("o_orderkey") % 4).alias("n_aligned"), (F.col("o_orderkey") % 6).alias("n_objectives"),
        F.when(F.col("o_orderkey") % 2 == 0, "f.json").otherwise("").alias("file_name"), (F.col("o_orderkey") % 6 > 1).alias("is_parsed"), (F.col("o_orderkey") % 4 > 1).alias("is_tagged"),
        F.when(F.col("o_orderkey") % 3 == 0, " 9-10 ").otherwise("K").alias("grade"), F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>" + "x" * 215 + "7")).alias("description"),
    )


# the queries of sorts return each row's position; ids make their orders total
@query("w2_sort_by_subject_title", f"with {_CATALOG} select id, subject, name as title, row_number() over (order by case subject when 'ela' then 0 when 'math' then 1 when 'history' then 2 else 3 end, lower(name), id) as position from cat")
def w2(s, d):
    rows = _catalog(s, d).select("id", "subject", F.col("name").alias("title"))
    return A.with_position(rows, [*A.subject_title_order(), "id"], stored)


@query("w3_sort_catalog", f"with {_CATALOG} select id, is_seed, created_at, row_number() over (order by is_seed, created_at desc, id) as position from cat")
def w3(s, d):
    return A.with_position(_catalog(s, d).select("id", "is_seed", "created_at"), [*A.catalog_order(), "id"], stored)


@query("w3_sort_by_name", f"with {_CATALOG} select id, name, row_number() over (order by lower(name), id) as position from cat")
def w3_name(s, d):
    return A.with_position(_catalog(s, d).select("id", "name"), [*A.catalog_order("name"), "id"], stored)


@query("w3_sort_by_aligned", f"with {_CATALOG} select id, n_aligned, n_objectives, row_number() over (order by case when n_objectives > 0 then n_aligned / n_objectives else 0 end desc, id) as position from cat")
def w3_aligned(s, d):
    return A.with_position(_catalog(s, d).select("id", "n_aligned", "n_objectives"), [*A.catalog_order("aligned"), "id"], stored)


@query("w3_sort_taxonomies", f"with {_CATALOG}, t as (select id, name as title, case when id % 3 <> 0 then is_seed end as is_seed, created_at from cat) select *, row_number() over (order by coalesce(is_seed, true), created_at desc, id) as position from t")
def w3_taxonomies(s, d):
    rows = _catalog(s, d).select("id", F.col("name").alias("title"), F.when(F.col("id") % 3 != 0, F.col("is_seed")).alias("is_seed"), "created_at")
    return A.with_position(rows, [*A.catalog_order(title="title", missing_is_seed=True), "id"], stored)


@query("w5_first_per_key", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as n from lineitem) where n = 1")
def w5(s, d):
    return A.first_per_key(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("w6_consecutive_runs", "select event_id, user_id, event_type, cast(sum(new) over (partition by user_id order by ts) as bigint) as run from (select *, case when lag(event_type) over (partition by user_id order by ts) is distinct from event_type then 1 else 0 end as new from events)")
def w6(s, d):
    return A.consecutive_runs(table(s, d, "events"), "event_type", ["ts"], ["user_id"]).select("event_id", "user_id", "event_type", "run")


@query("w7_cluster_1d", "with g as (select user_id, value, case when value - lag(value) over (partition by user_id order by value) >= 2.5 then 1 else 0 end as new from events), c as (select *, sum(new) over (partition by user_id order by value) as cluster from g) select user_id, cast(cluster as bigint) as cluster, count(*) as n, min(value) as lo, max(value) as hi, round(avg(value), 6) as center from c group by all")
def w7(s, d):
    return A.cluster_1d(table(s, d, "events"), "value", 2.5, ["user_id"]).withColumn("center", F.round("center", 6))


@query("w8_cluster_letters", "with f as (select p_type as domain, p_brand as cluster, min(p_partkey) as first from part group by all) select domain, cluster, first, chr(cast(64 + dense_rank() over (partition by domain order by first) as integer)) as letter from f")
def w8(s, d):
    return A.cluster_letters(table(s, d, "part").select(F.col("p_type").alias("domain"), F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("line_no")))


_SCIENCE = "sci as (select p_partkey as number, case p_size % 12 when 0 then 'K' when 1 then 'K-2' when 2 then '1' when 3 then '2' when 4 then '3' when 5 then '4' when 6 then '3-5' when 7 then '5' when 8 then 'MS' when 9 then 'HS' when 10 then '9' end as grade, p_type as topic from part)"


@query("w9_sort_by_grade", f"with {_SCIENCE} select *, row_number() over (order by case grade when 'K' then 0 when 'K-2' then 0.5 when '1' then 1 when '2' then 2 when '3' then 3 when '4' then 4 when '3-5' then 4.5 when '5' then 5 when 'MS' then 6 when 'HS' then 7 else 99 end, topic, number) as position from sci")
def w9(s, d):
    grade = F.get(F.array(*map(F.lit, (*A.SCIENCE_GRADES, "9", None))), F.col("p_size") % 12)
    rows = table(s, d, "part").select(F.col("p_partkey").alias("number"), grade.alias("grade"), F.col("p_type").alias("topic"))
    return A.with_position(rows, A.science_grade_order(), stored)


# joins


@query("j1_enrich_tags", f"with {TAGS}, r as (select 'C' || p_partkey as code, p_brand as strand, p_name as text from part where p_partkey % 3 = 0) select doc_id, path, code, confidence, strand, text from tags left join r using (code)")
def j1(s, d):
    r = table(s, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_brand").alias("strand"), F.col("p_name").alias("text"))
    return C.enrich_tags(tags(s, d), r, ["strand", "text"]).select("doc_id", "path", "code", "confidence", "strand", "text")


@query("j2_attach_section_titles", f"with {OBJECTIVES}, s as (select o_orderkey as doc_id, o_orderkey % 3 as section_idx, nullif(o_orderpriority, '5-LOW') as title from orders) select doc_id, path, coalesce(title, 'Section ' || (section_idx + 1)) as section_title from objs left join s using (doc_id, section_idx)")
def j2(s, d):
    sections = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("section_idx"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"))
    return C.attach_section_titles(objectives(s, d), sections).select("doc_id", "path", "section_title")


_SETS = "sets as (select 'C' || (p_partkey % 60) as code, p_partkey as ord, case when p_partkey % 4 = 0 then '' else p_name end as text from part)"


def _sets(s, d):
    return table(s, d, "part").select(F.concat(F.lit("C"), (F.col("p_partkey") % 60).cast("string")).alias("code"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name")).alias("text"))


@query("j3_fill_tag_text", f"with {TAGS}, {_SETS}, f as (select code, arg_min(text, ord) as text from sets where text <> '' group by 1) select doc_id, path, code, text from tags left join f using (code)")
def j3(s, d):
    return C.fill_tag_text(tags(s, d).withColumn("text", F.lit("")), _sets(s, d)).select("doc_id", "path", "code", "text")


@query("j4_find_by_code", f"with {TAGS}, {_SETS}, f as (select code, arg_min(text, (ord % 3) * 1000000 + ord) as text from sets group by 1) select distinct code, text from tags join f using (code)")
def j4(s, d):
    return C.find_by_code(tags(s, d), _sets(s, d), (F.col("ord") % 3) * 1000000 + F.col("ord"))


@query("j5_merge_record_sets", "select code, arg_min(id, (id % 2, id)) as id from (select p_brand || p_size as code, p_partkey as id from part) group by 1")
def j5(s, d):
    p = table(s, d, "part").withColumn("code", F.concat("p_brand", F.col("p_size").cast("string")))
    return C.merge_record_sets([p.where(f"p_partkey % 2 = {k}").withColumnRenamed("p_partkey", "id") for k in (0, 1)], "id").select("code", "id")


@query("j6_visible_rows", "select o_orderkey as id, o_orderstatus as status from orders where (o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)) or o_orderstatus <> 'F'")
def j6(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    hidden = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return C.visible_rows(rows.where("status = 'F'"), rows.where("status <> 'F'"), hidden)


_USING = "case when o_orderkey % 4 = 0 then ['T' || (o_custkey % 9), 'T1'] when o_orderkey % 4 = 1 then ['T' || (o_custkey % 9)] else ['T0'] end"


def _with_taxonomies(s, d):
    t = F.concat(F.lit("T"), (F.col("o_custkey") % 9).cast("string"))
    k = F.col("o_orderkey") % 4
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, F.array(t, F.lit("T1"))).otherwise(F.array().cast("array<string>")).alias("taxonomy_ids"), F.when(k == 1, t).otherwise("").alias("taxonomy_id"), F.lit("T0").alias("default_id"))


@query("j7_documents_using", f"select o_orderkey as id from orders where list_contains({_USING}, 'T1')")
def j7(s, d):
    return C.documents_using(_with_taxonomies(s, d), "T1").select("id")


@query("j7_adopted", "select c_custkey as id, c_name as title from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def j7b(s, d):
    return C.adopted(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))


_ORDER_RANGES = "r as (select o_orderkey as id, o_custkey as lo, o_custkey + case when o_orderkey % 50 = 0 then 200 else o_orderkey % 4 end as hi from orders)"


@query("j10_assign_ranges", f"with {_ORDER_RANGES} select s_suppkey, id from supplier join r on s_suppkey between lo and hi")
def j10(s, d):
    """Suppliers' numbers in ranges that all orders give, most of them short and some long."""
    k = F.col("o_orderkey")
    ranges = table(s, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.when(k % 50 == 0, 200).otherwise(k % 4)).alias("hi"))
    return C.assign_ranges(table(s, d, "supplier").select("s_suppkey"), ranges, "s_suppkey").select("s_suppkey", "range.id")


@query("j11_assign_nearest_left", """with st as (select user_id, value as start from events where event_type = 'click'), it as (select user_id, event_id, value, value + 0.5 as at from events where event_type <> 'click'),
    f as (select user_id, min(start) as first from st group by 1) select it.user_id, event_id, value, coalesce(st.start, first) as start from it asof left join st on it.user_id = st.user_id and it.at >= st.start left join f on f.user_id = it.user_id""")
def j11(s, d):
    """Each other event gets a click's value as start: the nearest to the left for its user, with slack."""
    e = table(s, d, "events").select("user_id", "event_id", "value", "event_type")
    starts = e.where("event_type = 'click'").select("user_id", F.col("value").alias("start"))
    return C.assign_nearest_left(e.where("event_type <> 'click'").drop("event_type"), starts, "value", "start", 0.5, ["user_id"])


@query("j11_one_list", "with st as (select distinct p_retailprice as start from part where p_size < 3), it as (select l_orderkey, l_linenumber, l_extendedprice, l_extendedprice / 20 as at from lineitem) select l_orderkey, l_linenumber, it.at as value, coalesce(st.start, (select min(start) from st)) as start from it asof left join st on it.at >= st.start")
def j11_one_list(s, d):
    """Prices of all lines against one list of starts."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20).alias("value"))
    starts = table(s, d, "part").where("p_size < 3").select(F.col("p_retailprice").alias("start"))
    return C.assign_nearest_left(lines, starts, "value", "start")


@query("j12_assign_range_owner", "with m as (select user_id, epoch(ts) - 2.0 as y, event_id as marker from events where event_type = 'click'), i as (select user_id, epoch(ts) as y, event_id as item from events where event_type <> 'click') select i.user_id, i.item, m.marker from i asof left join m on i.user_id = m.user_id and i.y >= m.y")
def j12(s, d):
    e = table(s, d, "events").withColumn("y", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return C.assign_range_owner(e.where("event_type <> 'click'").select("user_id", "y", F.col("event_id").alias("item")), e.where("event_type = 'click'").select("user_id", "y", F.col("event_id").alias("marker")), 2.0, ["user_id"]).select("user_id", "item", "marker")


@query("j13_flag_listed", "select p_partkey, (p_brand, p_size) in (select p_brand, p_size from part where p_partkey % 11 = 0) as listed from part")
def j13(s, d):
    p = table(s, d, "part")
    return C.flag_listed(p, p.where("p_partkey % 11 = 0"), ["p_brand", "p_size"]).select("p_partkey", "listed")


# status and browsing


@query("f10_document_status", f"with {_CATALOG} select id, case when is_seed or n_aligned > 0 then 'aligned' else 'raw' end as alignment, case when is_parsed then 'parsed' when file_name <> '' then 'needs_parse' else 'empty' end as parse, case when is_tagged then 'tagged' else 'pending' end as tag from cat")
def f10(s, d):
    return _catalog(s, d).select("id", C.document_status().alias("s")).select("id", "s.*")


# the description is searched as shown: without tags, and cut behind 219 characters, so that the 7 at its end is never found
@query("f11_filter_documents", f"with {_CATALOG} select id from cat where not is_seed and n_aligned > 0 and trim(grade) = '9-10' and (subject is null or subject in ('math', 'science')) and (contains(lower(name), '7') or contains(lower(grade), '7'))")
def f11(s, d):
    return C.filter_documents(_catalog(s, d), hide_seeds=True, alignment="aligned", grade="9-10", subject="math", search=" 7 ").select("id")


@query("f11_search_previews", f"with {_CATALOG} select id from cat where contains(lower(name), 'p') or contains(description, 'SPECIFIED')")
def f11_search(s, d):
    """A search for the letter of the tags finds it in names and in what the tags hold."""
    return C.filter_documents(_catalog(s, d), search="P").select("id")


@query("f12_filter_taxonomies", f"with {_CATALOG} select id from cat where not is_seed and (contains(lower(name), 'r 1') or contains(lower(grade), 'r 1') or contains(lower(subject), 'r 1'))")
def f12(s, d):
    return C.filter_taxonomies(_catalog(s, d).withColumnRenamed("name", "title"), hide_library=True, search="r 1").select("id")


@query("f13_browse_records", f"with {RECORDS}, f as (select * from recs where coalesce(nullif(strand, ''), category, case when is_practice then 'MP' else 'Other' end) = 'Brand#2' and (grade = '11-12' or grade_band = '11-12') and (contains(lower(code), 'e') or contains(lower(text), 'e') or ord % 3 = 0)) select code, (select count(*) from f) as total from f order by ord offset 5 limit 20")
def f13(s, d):
    r = records(s, d).withColumn("skill_category", F.when(F.col("ord") % 3 == 0, "Evidence"))
    page, total = C.browse_records(r, search="e", bucket="Brand#2", grade="11-12", limit=20, offset=5)
    return page.select("code", total.scalar().alias("total"))


@query("f14_search_objectives", "select conv_id as doc_id, turn, role from conversations where contains(lower(role), 'stem') or contains(lower(text), 'stem') or conv_id % 4 = 0 or conv_id % 50 = 7")
def f14(s, d):
    """Turns as objectives: their role is the title, their text the description, and every fourth conversation has a tag whose rationale holds the words."""
    tag = F.struct(F.lit("C1").alias("code"), F.lit("reads the SYSTEM").alias("rationale"), F.lit(None).cast("string").alias("text"))
    none = F.array().cast("array<struct<code: string, rationale: string, text: string>>")
    o = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.col("role").alias("title"), F.col("text").alias("description"), F.when(F.col("conv_id") % 50 == 7, "Stems").otherwise("Roots").alias("section_title"), F.when(F.col("conv_id") % 4 == 0, F.array(tag)).otherwise(none).alias("tags"))
    return C.search_objectives(o, "Stem").select("doc_id", "turn", "role")


@query("f14_search_aligned", f"with {TAGS} select distinct doc_id, path from tags where contains(lower(code), 'c4')")
def f14_aligned(s, d):
    o = objectives(s, d).select("*", *(F.lit("").alias(c) for c in ("title", "description", "section_title")))
    return C.search_objectives(o, "C4", only_aligned=True).select("doc_id", "path")


@query("f15_filter_confidence", f"with {TAGS} select doc_id, path, count(*) as n from tags where confidence in ('medium', 'high') group by all")
def f15(s, d):
    return objectives(s, d).select("doc_id", "path", F.size(E.filter_confidence("tags", 2)).cast("long").alias("n")).where("n > 0")


@query("p17_confidence", f"with {TAGS} select doc_id, path, code, case confidence when 'high' then 3 when 'medium' then 2 else 1 end as rank, case confidence when 'high' then 90 when 'medium' then 70 else 50 end as value from tags")
def p17(s, d):
    from ..functions.grades import confidence_value

    return tags(s, d).select("doc_id", "path", "code", confidence_rank("confidence").alias("rank"), confidence_value("confidence").alias("value"))


# maintenance


@query("t1_insert_rows", "select o_orderkey as id, o_orderpriority as subject, true as is_public from orders where o_orderkey % 2 = 0 union all select o_orderkey, nullif(lower(trim(case when o_orderkey % 5 = 0 then ' ' else '  ' || o_orderpriority || ' ' end)), ''), coalesce(case when o_orderkey % 3 = 0 then null else o_orderkey % 3 = 1 end, true) from orders where o_orderkey % 2 = 1")
def t1(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"))
    new = o.where("id % 2 = 1").select("id", F.when(F.col("id") % 5 == 0, " ").otherwise(F.concat(F.lit("  "), "subject", F.lit(" "))).alias("subject"), F.when(F.col("id") % 3 != 0, F.col("id") % 3 == 1).alias("is_public"))
    return C.insert_rows(o.where("id % 2 = 0").withColumn("is_public", F.lit(True)), new)


@query("t2_patch_rows", """with c as (select o_orderkey as id, o_orderpriority as name, o_orderstatus as subject, o_orderstatus = 'F' as is_seed, o_orderdate as updated_at from orders)
    select id, case when on_ then 'new' || id else name end as name, case when on_ and id % 6 = 0 then null when on_ and id % 9 = 0 then 'math' when on_ and id % 15 = 0 then null else subject end as subject, case when on_ then timestamp '2020-01-01' else updated_at end as updated_at from (select *, not is_seed and id % 3 = 0 as on_ from c)""")
def t2(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("subject"), (F.col("o_orderstatus") == "F").alias("is_seed"), F.col("o_orderdate").alias("updated_at"))
    name = F.concat(F.lit(" new"), F.col("id").cast("string"), F.lit("\t"))
    subject = F.when(F.col("id") % 6 == 0, F.lit(None).cast("string")).when(F.col("id") % 9 == 0, " MATH ").when(F.col("id") % 15 == 0, "  ")
    both = F.create_map(F.lit("name"), name, F.lit("subject"), subject)
    patches = o.where("id % 3 = 0").select("id", F.when((F.col("id") % 6 == 0) | (F.col("id") % 9 == 0) | (F.col("id") % 15 == 0), both).otherwise(F.create_map(F.lit("name"), name)).alias("set"), F.expr("cast('2020-01-01' as timestamp)").cast(dict(o.dtypes)["updated_at"]).alias("updated_at"))
    return C.patch_rows(o, patches, ["name", "subject"]).select("id", "name", "subject", "updated_at")


@query("t3_delete_rows", "select 'left' as part, o_orderkey as id from orders where not (o_orderstatus <> 'F' and o_orderkey % 4 = 0) union all select 'hidden', o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 4 = 0 union all select 'lines', l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F' and o_orderkey % 4 = 0)")
def t3(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_seed"))
    left, hidden, (lines,) = C.delete_rows(o, o.where("id % 4 = 0"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")))
    return left.select(F.lit("left").alias("part"), "id").unionByName(hidden.select(F.lit("hidden").alias("part"), "id")).unionByName(lines.select(F.lit("lines").alias("part"), "id"))


@query("t5_toggle_sections", "select doc_id, section_idx from (select user_id as doc_id, event_id % 3 as section_idx, arg_max(event_type = 'click', ts) as x from events group by all) where x")
def t5(s, d):
    return C.toggle_sections(table(s, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("section_idx"), (F.col("event_type") == "click").alias("excluded"), "ts"))


@query("t6_latest_by_key", "select user_id, arg_max(event_id, ts) as event_id, arg_max(value, ts) as value from events group by 1")
def t6(s, d):
    return C.latest_by_key(table(s, d, "events").select("user_id", "event_id", "value", "ts"), "user_id", ["ts"]).select("user_id", "event_id", "value")


@query("t7_replace_tags", f"""with {OBJECTIVES}, n as (select doc_id, path, case when doc_id % 5 = 0 then 2 else n_tags end as n_tags from objs), f as (select arg_min(p_name, p_partkey) as text from part where p_brand = 'Brand#1')
    select doc_id, path, n_tags, case when doc_id % 5 = 0 then (select text from f) || '|own' else repeat('|', greatest(cast(n_tags as bigint) - 1, 0)) end as texts, count(*) over (partition by doc_id) as n_objectives, count(*) filter (where n_tags > 0) over (partition by doc_id) as n_aligned from n""")
def t7(s, d):
    """Every fifth order gets a tag whose text comes from the taxonomy, one with its own text, and one without code, which goes."""
    o = objectives(s, d)
    new = F.array(*(F.struct(F.lit(c).alias("code"), F.lit("high").alias("confidence"), F.lit("").alias("rationale"), F.lit(t).alias("text")) for c, t in (("Brand#1", " "), ("", "x"), ("Brand#2", " own "))))
    texts = table(s, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    out = C.replace_tags(o, o.where("doc_id % 5 = 0").select("doc_id", "path", new.alias("tags")), texts)
    return out.select("doc_id", "path", F.col("n_tags").cast("long").alias("n_tags"), F.array_join(F.transform("tags", lambda t: t["text"]), "|").alias("texts"), "n_objectives", "n_aligned")


@query("t8_document_detail", f"""with u as (select o_orderkey as id, unnest({_USING}) as taxonomy, generate_subscripts({_USING}, 1) as pos from orders), t as (select 'T' || s_suppkey as taxonomy, s_name as title from supplier),
    g as (select id, string_agg(title, ' + ' order by pos) as title from u join t using (taxonomy) group by 1), a as (select l_orderkey as id, count(*) as n, count(*) filter (where l_quantity >= 10) as m from lineitem group by 1),
    w as (select o_orderkey as id, case when o_orderkey % 6 = 1 and n is not null then 'stored' else title end as taxonomy_title, coalesce(n, 0) as n_objectives, coalesce(m, 0) as n_aligned, n is not null as has, o_orderstatus = 'O' as has_file from orders o left join g on g.id = o_orderkey left join a on a.id = o_orderkey)
    select id, taxonomy_title, n_objectives, n_aligned, case when n_aligned > 0 then 'aligned' else 'raw' end as alignment, case when has and id % 2 = 0 then 'parsed' when has_file then 'needs_parse' else 'empty' end as parse, case when has and id % 2 = 1 then 'tagged' else 'pending' end as tag from w""")
def t8(s, d):
    """Orders with even keys have a parse alone, the others an alignment; some alignments store a title."""
    tag = F.when(F.col("l_quantity") >= 10, F.array(F.lit("C"))).otherwise(F.array().cast("array<string>"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(tag.alias("tags"))).alias("objectives"))
    titles = table(s, d, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"))
    files = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "f.json").alias("file_name"))
    aligned = lines.where("id % 2 = 1").withColumn("taxonomy_title", F.when(F.col("id") % 6 == 1, "stored"))
    out = C.document_detail(_with_taxonomies(s, d).join(files, "id"), lines.where("id % 2 = 0"), aligned, titles)
    return out.select("id", "taxonomy_title", F.col("n_objectives").cast("long").alias("n_objectives"), F.col("n_aligned").cast("long").alias("n_aligned"), "status.*")
