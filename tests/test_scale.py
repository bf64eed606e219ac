"""Steps whose shuffles or memory grew faster than their input."""

import contextlib
import io

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tagweave.operators import tfidf as T
from tagweave.plans import registry, text_queries
from tagweave.sources import documents as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_vectors_by_batches_equal_the_join(spark):
    corpus = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue sea"), (3, None)], "record_id int, text string")
    asked = spark.createDataFrame([("a", "Blue fish fish"), ("a", "sea and sea"), ("b", None), ("c", "nothing known"), ("d", ""), (None, "red fish")], "query_id string, text string")
    idf = T.fit_tfidf(corpus)[1]
    both = [sorted(((r[0] or "", r[1], round(r[2], 9)) for r in T.transform_tfidf(asked, idf, method=m).collect())) for m in ("join", "auto")]
    assert both[0] == both[1] and len(both[0]) == 7


def test_no_terms_or_pairs_are_shuffled_for_a_small_corpus(spark):
    for name in ("r3_transform_tfidf", "r4_cosine_scores", "r7_attach_fields"):
        told = plan(registry.queries()[name](spark, SF))
        assert "MapInArrow" in told and "term" not in "".join(line for line in told.splitlines() if "Exchange hashpartitioning" in line)


def test_lines_move_once_for_all_subjects(spark):
    told = plan(registry.queries()["k8_rerank"](spark, SF))
    assert "subject" not in "".join(line for line in told.splitlines() if "Exchange hashpartitioning" in line)


def test_postings_of_asked_terms_have_the_norms_of_whole_records(spark):
    corpus = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue sea"), (3, None)], "record_id int, text string")
    terms = spark.createDataFrame([("fish",), ("blue",), ("unknown",)], "term string")
    some = T.fit_tfidf(corpus, terms=terms)[0].collect()
    every = T.fit_tfidf(corpus)[0].where("term in ('fish', 'blue')").collect()
    assert sorted((r[0], r[1], round(r[2], 9)) for r in some) == sorted((r[0], r[1], round(r[2], 9)) for r in every) and len(some) == 3


def test_documents_get_a_file_each_without_the_writer_of_spark(spark, tmp_path, monkeypatch):
    """Named by their ids, without checksums, and with the rows that Spark's own writer gave."""
    monkeypatch.setattr(text_queries, "_scratch", lambda s, name: f"file://{tmp_path}/{name}")
    got = registry.queries()["s1_read_documents"](spark, SF).collect()
    ids = {str(r.conv_id) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {p.name for p in (tmp_path / "documents").iterdir()} == {f"{i}.json" for i in ids} and {r.doc_id for r in got} == ids
    docs = text_queries._nested(spark, SF).withColumnRenamed("doc_id", "id")
    docs.write.option("pretty", True).option("maxRecordsPerFile", 1).json(f"file://{tmp_path}/spark")
    new, old = (S.read_documents(spark, f"file://{tmp_path}/{x}").drop("doc_id") for x in ("documents", "spark"))
    assert new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()


def test_odd_documents_come_back_from_their_files(spark, tmp_path):
    rows = [("a b", 'say "x"\n\\ \u2028 \U0001f600'), ("-5", None), ("%20", ""), ("\u00e9.final", "t" * 100_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "id string, title string").repartition(3)
    for start, folder in (("file://", "one"), ("file:", "with space"), ("", "plain%20path")):
        path = f"{start}{tmp_path}/{folder}"
        S.write_documents(docs, path, F.coalesce("id", F.lit("null")))
        assert {p.name for p in (tmp_path / folder).iterdir()} == {f"{i or 'null'}.json" for i, _ in rows}
        got = S.read_documents(spark, path).collect()
        assert {(r.id, r.title) for r in got} == set(rows) and len(got) == len({r.doc_id for r in got}) == len(rows)
        assert {"-5", "null"} < {r.doc_id for r in got}
    S.write_documents(docs.limit(0), f"file://{tmp_path}/empty", F.col("id"))
    assert S.read_documents(spark, f"file://{tmp_path}/empty").count() == 0


def test_no_document_is_lost_by_its_name(spark, tmp_path):
    docs = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "id string, title string")
    with pytest.raises(ValueError, match="3 documents became 2 files"):
        S.write_documents(docs, f"file://{tmp_path}/repeated", F.col("id"))
    for k, bad in enumerate(("../up", "_hidden", ".hidden", "", None)):
        with pytest.raises(PythonException, match="no name of a file"):
            S.write_documents(docs.limit(1), f"file://{tmp_path}/bad{k}", F.lit(bad))


def test_documents_in_a_store_that_only_spark_writes(spark, tmp_path):
    (tmp_path / "there").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}/there")
    docs = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "id string, title string").coalesce(1)
    S.write_documents(docs, "viewfs://docs/in/out", F.col("id"))
    got = S.read_documents(spark, "viewfs://docs/in/out").collect()
    assert sorted((r.id, r.title) for r in got) == [("x", "1"), ("x", "3"), ("y", "2")] and len({r.doc_id for r in got}) == 3


def test_postings_of_terms_that_nobody_asks_are_not_shuffled(spark, tmp_path):
    """1,500 documents with 351,430 postings, nearly all of words of their own."""
    docs = [(i, f"fish{i % 7} " + " ".join(f"x{i}y{j}" for j in range(10 + i // 7))) for i in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"fish{i}") for i in range(7)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shuffled() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = registry.queries()["r5_pruned_top_k"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.rank, r.record_id) for r in got) == [(i, n + 1, i + 7 * n) for i in range(7) for n in range(3)]
    assert shuffled() - before < 50_000
