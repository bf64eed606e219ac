"""Queries of segmenting text lines (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as G
from ..sources.documents import read_lines
from .base import query, table

_LINES = r"lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split_regex(text, '\r?\n') as l from documents))"
# lines that start with a capital letter stand for item starts; lines with a question mark or a long one for headers
_ITEM = "^[A-E]"


def _lines(s, d):
    return read_lines(table(s, d, "documents"))


@query("g1_drop_noise_lines", rf"with {_LINES} select doc_id, line_no, line from lines where not regexp_matches(line, '^\s*$|^\s*\d{{1,3}}\s*$|rights reserved')")
def g1(s, d):
    return G.drop_noise_lines(_lines(s, d), (*G.NOISE, "rights reserved")).withColumn("line_no", F.col("line_no").cast("long"))


@query("g2_split_inline_items", rf"with {_LINES}, p as (select doc_id, line_no, list_filter(string_split(regexp_replace(line, '(\. )([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x) <> '') as l from lines) select doc_id, line_no, unnest(range(len(l))) as part, unnest(l) as line from p")
def g2(s, d):
    return G.split_inline_items(_lines(s, d), r"\. (?=[A-Z])").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("part").cast("long").alias("part"), "line")


@query("g3_section_bounds", rf"""with {_LINES}, h as (select *, regexp_matches(line, '^[A-M]') and coalesce(regexp_matches(lead(line) over (partition by doc_id order by line_no), '^[N-Z]'), false) as head from lines),
    b as (select doc_id, min(line_no) filter (where head) as start from h group by 1) select doc_id, any_value(start) as start, min(line_no) filter (where line_no > start and regexp_matches(line, '^T')) as "end" from lines join b using (doc_id) group by 1""")
def g3(s, d):
    return G.section_bounds(_lines(s, d), ("^[A-M]", "^[N-Z]"), "^T").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("g4_carry_headers", rf"""with {_LINES}, g as (select *, sum(case when regexp_matches(line, '^([A-E]\S*)') then 1 else 0 end) over (partition by doc_id order by line_no) as level from lines),
    c as (select doc_id, line_no, last_value(case when regexp_matches(line, '^([A-E]\S*)') then regexp_extract(line, '^([A-E]\S*)', 1) end ignore nulls) over (partition by doc_id order by line_no) as grade,
    last_value(case when regexp_matches(line, '^([F-O]\S*)') then regexp_extract(line, '^([F-O]\S*)', 1) end ignore nulls) over (partition by doc_id, level order by line_no) as domain from g) select doc_id, line_no, grade, domain from c""")
def g4(s, d):
    return G.carry_headers(_lines(s, d), [("grade", r"^([A-E]\S*)"), ("domain", r"^([F-O]\S*)")]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "grade", "domain")


@query("g5_assemble_items", rf"""with {_LINES}, n as (select *, sum(case when regexp_matches(line, '^([A-E])') then 1 else 0 end) over (partition by doc_id order by line_no) as item from lines)
    select doc_id, cast(item as bigint) as item, count(*) as n_lines, trim(regexp_replace(string_agg(line, ' ' order by line_no), '[\s\p{{Z}}]+', ' ', 'g')) as text from n where item > 0 group by doc_id, item""")
def g5(s, d):
    return G.assemble_items(_lines(s, d), r"^([A-E])").select("doc_id", F.col("item").cast("long").alias("item"), "n_lines", "text")


_ITEMS = "items as (select user_id as doc_id, event_id as line_no, event_type as prefix, cast(value as integer) % 5 as number, case when event_id % 3 = 0 then null else chr(97 + cast(event_id % 3 as integer)) end as sub from events)"


@query("g6_mint_codes", f"""with {_ITEMS}, t as (select *, last_value(case when sub is null then prefix || '.' || number end ignore nulls) over (partition by doc_id, prefix order by line_no) as top from items)
    select line_no, case when sub is null then top else top || '.' || sub end as code, case when sub is not null then top end as parent_code from t where top is not null""")
def g6(s, d):
    return G.mint_codes(_numbers(s, d)).select("line_no", "code", "parent_code")


def _numbers(s, d):
    sub = F.when(F.col("event_id") % 3 != 0, F.char(97 + F.col("event_id") % 3))
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("prefix"), (F.rint("value").cast("int") % 5).alias("number"), sub.alias("sub"))


@query("g6_mint_skill_codes", f"with {_ITEMS} select line_no, '9-12.' || prefix || '.' || number as code, cast(null as varchar) as parent_code from items where prefix <> 'view'")
def g6_skills(s, d):
    """The third scheme: band, category and number; items without a category go."""
    items = _numbers(s, d).select("line_no", F.lit("9-12").alias("band"), F.when(F.col("prefix") != "view", F.col("prefix")).alias("category"), "number")
    return G.mint_codes(items, "band", "number", category="category").select("line_no", "code", "parent_code")


@query("g6_skip_other_grades", rf"with {_LINES} select doc_id, line_no, line from lines where not (line_no % 4 = 1)")
def g6_grades(s, d):
    """Every fourth line is made an item of another grade, every other fourth one of the own grade, which stays."""
    item = F.when(F.col("line_no") % 4 == 1, F.lit("K.1 Students ")).when(F.col("line_no") % 4 == 2, F.lit("5.2 students "))
    lines = _lines(s, d).withColumn("grade", F.lit("5")).withColumn("was", F.col("line")).withColumn("line", F.when(item.isNotNull(), F.concat(item, "line")).otherwise(F.col("line")))
    return G.skip_other_grades(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("was").alias("line"))


_CODED = """coded as (select item_id as doc_id, 'Intro HS-PS' || (1 + item_id % 4) || '-1. ' || text || '* [Clarification Statement: look ' || item_id || '] [Assessment Boundary: not ' || item_id || ']  MS-LS2-3. Second ' || item_id || ' Disciplinary Core Ideas tail K-2-ETS1-2. Third.' as text from benchmark)"""


def _coded(s, d):
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("Intro HS-PS"), (1 + F.col("item_id") % 4).cast("string"), F.lit("-1. "), "text", F.lit("* [Clarification Statement: look "), i, F.lit("] [Assessment Boundary: not "), i, F.lit("]  MS-LS2-3. Second "), i, F.lit(" Disciplinary Core Ideas tail K-2-ETS1-2. Third."))
    return table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), text.alias("text"))


_BODY = r"ltrim(regexp_replace(b.text, '\s+', ' ', 'g')) || '* [Clarification Statement: look ' || item_id || '] [Assessment Boundary: not ' || item_id || ']'"


@query("g7_split_coded_text", f"select item_id as doc_id, 1 as n, 'HS-PS' || (1 + item_id % 4) as topic, 1 as number, {_BODY} as body from benchmark b union all select item_id, 2, 'MS-LS2', 3, 'Second ' || item_id from benchmark union all select item_id, 3, 'K-2-ETS1', 2, 'Third.' from benchmark")
def g7(s, d):
    return G.split_coded_text(_coded(s, d))


@query("g8_split_annotations", r"select item_id as doc_id, 'look ' || item_id as clarification, 'not ' || item_id as assessment_boundary, true as engineering, trim(regexp_replace(text, '\s+', ' ', 'g')) as statement from benchmark")
def g8(s, d):
    one = G.split_coded_text(_coded(s, d)).where("n = 1")
    return G.split_annotations(one).select("doc_id", "clarification", "assessment_boundary", "engineering", "statement")


@query("g9_derive_code_parts", r"""select item_id as doc_id, 'HS-PS' || (1 + item_id % 4) || '-1' as code, 'HS' as grade, 'HS' as grade_band, 'PS' as domain, cast(1 + item_id % 4 as integer) as topic_number, ['Matter and Its Interactions', 'Motion and Stability: Forces and Interactions', 'Energy', 'Waves and their Applications in Technologies for Information Transfer'][1 + item_id % 4] as topic_name, 'Physical Sciences' as domain_name, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' look ' || item_id as text from benchmark
    union all select item_id, 'MS-LS2-3', 'MS', 'MS', 'LS', 2, 'Ecosystems: Interactions, Energy, and Dynamics', 'Life Sciences', 'Second ' || item_id from benchmark union all select item_id, 'K-2-ETS1-2', 'K-2', 'K-5', 'ETS', 1, 'Engineering Design', 'Engineering, Technology, and Applications of Science', 'Third.' from benchmark""")
def g9(s, d):
    return G.derive_code_parts(G.split_annotations(G.split_coded_text(_coded(s, d)))).select("doc_id", "code", "grade", "grade_band", "domain", "topic_number", "topic_name", "domain_name", "text")


@query("g10_extract_markers", r"select p_partkey, p_partkey % 2 = 0 as ca_addition, p_partkey % 3 = 0 as modeling, p_partkey % 5 = 0 as plus_standard, p_name as text, case when p_partkey % 7 = 0 then 'CCSS.MATH.PRACTICE.' else 'CCSS.MATH.CONTENT.' end || p_partkey as full_code from part")
def g10(s, d):
    k = F.col("p_partkey")
    marked = F.concat(F.when(k % 5 == 0, " (+) ").otherwise(""), "p_name", F.when(k % 3 == 0, "★").otherwise(""), F.when(k % 2 == 0, "  CA.").otherwise(""))
    section = F.when(k % 7 == 0, "Mathematical Practices").otherwise("Content")
    return G.extract_markers(table(s, d, "part").select("p_partkey", marked.alias("text"))).select("p_partkey", "ca_addition", "modeling", "plus_standard", "text", G.full_code(k.cast("string"), section).alias("full_code"))


@query("g11_walk_clusters")
def g11(s, d):
    """All lines under a grade, a domain and a first cluster; every seventh is made a cluster heading, the others numbered items."""
    n = (F.col("line_no") + 5) % 7
    line = F.when(n == 0, F.concat(F.lit("Represent "), F.lower("line"), F.lit("."))).otherwise(F.concat(n.cast("string"), F.lit(". "), "line"))
    head = F.array(F.lit("     Grade 3"), F.lit("Operations 3.OA"), F.lit("Represent and solve."))
    heads = table(s, d, "documents").select("doc_id", F.posexplode(head).alias("line_no", "line"))
    lines = _lines(s, d).select("doc_id", (F.col("line_no") + 3).alias("line_no"), line.alias("line"))
    return G.walk_clusters(heads.unionByName(lines).withColumn("doc_id", F.col("doc_id").cast("string")), ["OA"])


@query("g12_extract_numbered", "select item_id as doc_id, unnest([1, 2]) as number, unnest([trim('First ' || item_id || ' ' || text) || ' see 1. Again', 'Second item ' || item_id || ' ' || text || ' too']) as item_text from benchmark")
def g12(s, d):
    """The benchmark texts as first and second item; an item's own number does not end it, and what follows the second on the page goes."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("Head 1. lower 1. First "), i, F.lit(" "), "text", F.lit(" see 1. Again 2. Second item "), i, F.lit(" "), "text", F.lit(" too *These broad types of text *2 3. Short Note here"))
    return G.extract_numbered(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), text.alias("text")), [1, 2, 3, 4], ["Note here"])
