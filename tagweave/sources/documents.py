"""Nested documents, taxonomies, finals and text lines: schemas, readers and writers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grades import first_present

DOCUMENT = """
    id string, title string, description string, name string, grade string, grade_band string, subject string,
    sections array<struct<title string, name string, description string,
        objectives array<struct<title string, description string, evaluation_type string, audience string, points long>>>>
"""
FINAL = """
    id string, title string, source_file string, subject string, inferred_grade_bands array<string>, standards_db string, notes string,
    objectives array<struct<path string, title string, description string, note string,
        alignments array<struct<code string, confidence string, rationale string>>>>
"""
RECORD = """
    code string, full_code string, section string, grade string, grade_band string, text string, parent_code string, number int,
    sub_letter string, ca_addition boolean, strand string, strand_name string, subgroup string, anchor_code string, is_anchor boolean,
    source_page int, category string, category_name string, domain string, domain_code string, domain_name string,
    cluster_letter string, cluster string, is_practice boolean, plus_standard boolean, modeling boolean, course_title string,
    skill_category string, skill_category_code string, is_skill boolean, sub_number int, topic string, topic_name string,
    topic_number int, pe_number int, statement string, clarification string, assessment_boundary string, engineering boolean
"""
RESULT_SUFFIX = r"\.(ela|math|history|science)\.alignment\.json$"
DEFAULT_TAXONOMY = "taxonomies/ela.json"


def _stem(ext: str = r"\.json") -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?)(?:\.final)?{ext}$", 1)


def read_documents(spark: SparkSession, glob: str, schema: str = DOCUMENT) -> DataFrame:
    """One row per JSON file, with the file's stem as doc_id."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).select(_stem().alias("doc_id"), "*")


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names in the local file system, which may be a mounted one; null in other stores."""
    if path.startswith("/"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    found = re.fullmatch(r"file:(?://)?(/(?!/).*)", path)
    return found and found[1]


def _put_files(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes each value under its name, and counts them. A file appears whole, and a repeated attempt of a task gives the same files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = os.path.join(folder, f".{uuid.uuid4().hex}")
        for batch in batches:
            for name, value in zip(batch["name"].to_pylist(), batch["value"]):
                if not name or name.startswith((".", "_")) or "/" in name:
                    raise ValueError(f"no name of a file that is read: {name}")
                with open(part, "wb") as f:
                    f.write(value.as_buffer())
                os.replace(part, os.path.join(folder, f"{name}.json"))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return put


def write_documents(docs: DataFrame, path: str, name: Column) -> None:
    """Writes each row as a JSON file of several lines into a new folder, as `read_documents()` wants it.

    Hadoop's local file system starts four processes for each file that it makes (chmod of the file and of its checksums), so there the tasks
    write the files, as `name`.json; names must differ. Other stores have no such cost: Spark writes, under names of its own."""
    folder = _local_folder(docs.sparkSession, path)
    if folder is None:
        docs.write.option("pretty", True).option("maxRecordsPerFile", 1).json(path)
        return
    os.makedirs(folder)
    files = docs.select(name.cast("string").alias("name"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    rows = files.mapInArrow(_put_files(folder), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    there = sum(x.endswith(".json") for x in os.listdir(folder))
    if rows != there:
        raise ValueError(f"{rows} documents became {there} files: names are repeated, or tasks do not share {folder}")


def read_finals(spark: SparkSession, glob: str, id_field: str = "id", title_field: str = "title") -> DataFrame:
    """Reviewed documents; `id_field` and `title_field` are what the files call a document's id and title."""
    rest = FINAL.split("title string,", 1)[1]
    read = read_documents(spark, glob, f"`{id_field}` string, `{title_field}` string, {rest}")
    return read.withColumnsRenamed({id_field: "id", title_field: "title"})


def read_taxonomy(spark: SparkSession, paths: dict[str, str], schema: str = RECORD) -> DataFrame:
    """Records of all subjects; a file may be an array of records or hold them in `records`."""
    out = None
    for subject, path in paths.items():
        both = spark.read.schema(f"{schema}, records array<struct<{schema}>>").option("multiLine", True).json(path)
        one = taxonomy_rows(both, subject)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def taxonomy_rows(both: DataFrame, subject: str) -> DataFrame:
    """Records of rows that are one record each or hold an array of them in `records`."""
    bare = both.where("records is null").drop("records")
    wrapped = both.where("records is not null").selectExpr("inline(records)")
    return bare.unionByName(wrapped).where("code is not null").withColumn("subject", F.lit(subject))


def list_inputs(df: DataFrame, include: str = r"\.json$", exclude: str = RESULT_SUFFIX, file: str = "file") -> DataFrame:
    """Rows whose file name matches, without those of per-subject results."""
    return df.where(F.col(file).rlike(include) & ~F.col(file).rlike(exclude))


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("subject",)) -> None:
    """Writes by key and replaces only the keys that `df` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


_OBJECTIVE = ("doc_id", "subject", "section_idx", "objective_idx", "path")


def to_nested(candidates: DataFrame, fields: Sequence[str] = ("code", "score"), objectives: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """One row per document and subject: its header's fields, and objectives in order, each with its own fields and its candidates in rank order.

    `fields` are the candidates' fields to keep beside their rank. `objectives` (keys and any other columns, such as titles, matched rules
    and picks) also brings objectives without candidates, `headers` (doc_id, subject and any other columns) documents without objectives."""
    listed = F.sort_array(F.collect_list(F.struct("rank", *fields)))
    each = candidates.groupBy(*_OBJECTIVE).agg(listed.alias("candidates"))
    own: list[str] = []
    if objectives is not None:
        own = [c for c in objectives.columns if c not in _OBJECTIVE]
        each = objectives.join(each, list(_OBJECTIVE), "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(each.schema["candidates"].dataType)))
    placed = F.sort_array(F.collect_list(F.struct("section_idx", "objective_idx", "path", F.struct("path", *own, "candidates").alias("o"))))
    out = each.groupBy("doc_id", "subject").agg(F.transform(placed, lambda x: x["o"]).alias("objectives"))
    if headers is None:
        return out
    rest = [c for c in headers.columns if c not in ("doc_id", "subject")]
    joined = headers.join(out, ["doc_id", "subject"], "left").withColumn("objectives", F.coalesce("objectives", F.array().cast(out.schema["objectives"].dataType)))
    return joined.select("doc_id", "subject", *rest, "objectives")


def write_nested(nested: DataFrame, path: str, compression: str = "none") -> None:
    """Writes one JSON record a line, in order of subject and document within and between the files; nulls are written."""
    nested.repartitionByRange("subject", "doc_id").sortWithinPartitions("subject", "doc_id").write.option("ignoreNullFields", False).json(path, compression=compression)


def prune_document(docs: DataFrame) -> DataFrame:
    """Titles, descriptions, types and points alone, empty where missing."""

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    def objective(o: Column) -> Column:
        return F.struct(text(o["title"]).alias("title"), text(o["description"]).alias("description"), text(o["evaluation_type"]).alias("evaluation_type"), o["points"].alias("points"))

    def section(s: Column) -> Column:
        inner = F.coalesce(F.transform(s["objectives"], objective), F.array())
        return F.struct(text(s["title"]).alias("title"), text(s["description"]).alias("description"), inner.alias("objectives"))

    return docs.select("doc_id", text(F.col("title")).alias("title"), text(F.col("description")).alias("description"), F.coalesce(F.transform("sections", section), F.array()).alias("sections"))


def build_manifest(finals: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per final with defaults for subject, taxonomy and title, and whether its source is there. `sources` has doc_id."""
    have = sources.select("doc_id").distinct().withColumn("has", F.lit(True))
    return finals.join(have, "doc_id", "left").select(
        "doc_id",
        F.coalesce(first_present("subject"), F.lit("ela")).alias("subject"),
        F.coalesce(first_present("standards_db"), F.lit(DEFAULT_TAXONOMY)).alias("taxonomy"),
        F.coalesce(first_present("title"), F.col("doc_id")).alias("title"),
        F.coalesce("has", F.lit(False)).alias("has_source"),
    )


def read_lines(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per line of each text, numbered from 0."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
