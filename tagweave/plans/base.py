"""The registered queries: operators on stand-in tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# stand-ins for domain tables, in Spark and as SQL

#: Order lines of quantity 10 or more are tags; an order is a document, its line number an objective.
TAGS = """tags as (select l_orderkey as doc_id, 'sections[' || (l_linenumber % 3) || '].objectives[' || l_linenumber || ']' as path,
    l_linenumber % 3 as section_idx, 'C' || (l_partkey % 50) as code,
    case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'low' end as confidence from lineitem where l_quantity >= 10)"""
OBJECTIVES = """objs as (select l_orderkey as doc_id, 'sections[' || (l_linenumber % 3) || '].objectives[' || l_linenumber || ']' as path,
    l_linenumber % 3 as section_idx, l_linenumber <> 2 as counts, count(*) filter (where l_quantity >= 10) as n_tags,
    count(*) filter (where l_quantity >= 10 and l_returnflag = 'A') as high, count(*) filter (where l_quantity >= 10 and l_returnflag = 'N') as medium,
    count(*) filter (where l_quantity >= 10 and l_returnflag not in ('A', 'N')) as low from lineitem group by all)"""
EXCLUSIONS = "excl as (select o_orderkey as doc_id, 1 as section_idx from orders where o_orderkey % 7 = 0)"
KEPT = "kept as (select * from objs anti join excl using (doc_id, section_idx)), kept_tags as (select * from tags anti join excl using (doc_id, section_idx))"
RECORDS = """recs as (select 'C' || p_partkey as code, p_partkey as ord, p_name as text, case when p_partkey % 4 = 0 then '' else p_brand end as strand,
    case when p_partkey % 3 = 0 then null else p_type end as category, case p_size % 6 when 0 then 'K' when 1 then '9-10' when 2 then 'K-2' when 3 then 'HS' when 4 then '' else cast(p_size as varchar) end as grade,
    '11-12' as grade_band, p_partkey % 5 = 0 as is_practice from part)"""


def tags(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where("l_quantity >= 10")
    return line.select(
        F.col("l_orderkey").alias("doc_id"), _path().alias("path"), (F.col("l_linenumber") % 3).alias("section_idx"),
        F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("code"), _confidence().alias("confidence"),
    )


def _path():
    return F.format_string("sections[%d].objectives[%d]", F.col("l_linenumber") % 3, F.col("l_linenumber"))


def _confidence():
    return F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")


def objectives(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("l_quantity") >= 10, F.struct(F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("code"), _confidence().alias("confidence"), F.lit("").alias("rationale"), F.lit("").alias("text")))
    line = table(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("doc_id"), _path().alias("path"), (F.col("l_linenumber") % 3).alias("section_idx"), (F.col("l_linenumber") != 2).alias("counts")).agg(F.collect_list(tag).alias("tags"))


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("section_idx"))


def records(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 6
    return table(spark, d, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"),
        F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("strand"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("category"),
        F.when(size == 0, "K").when(size == 1, "9-10").when(size == 2, "K-2").when(size == 3, "HS").when(size == 4, "").otherwise(F.col("p_size").cast("string")).alias("grade"),
        F.lit("11-12").alias("grade_band"), (F.col("p_partkey") % 5 == 0).alias("is_practice"),
        *(F.lit(None).cast("string").alias(c) for c in ("skill_category_code", "domain", "section", "strand_name", "category_name", "domain_name", "course_title")),
    )
