"""Report rows and pages, caps, thresholds, encodings: edge rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, ddl, evaluate, ranking, search
from lodestone.sources import readers, writers

TABLES = "tables array<struct<name:string,columns:array<string>>>"


def test_question_stats(spark):
    rows = [([("a", ["x", "y"]), ("b", None)],), ([],), (None,), ([("c", ["x"])],)]
    assert tuple(evaluate.question_stats(spark.createDataFrame(rows, TABLES)).first()) == (4, 3, 3, 0.75, 0.75)
    assert tuple(evaluate.question_stats(spark.createDataFrame([], TABLES)).first()) == (0, 0, 0, None, None)


def test_caps(spark):
    df = spark.createDataFrame([(d, i) for d in "cab" for i in range(8)], "db string, id int")
    order = [F.asc("id")]
    assert sorted(map(tuple, ranking.capped(df, "db", order, test=True).collect())) == [(d, i) for d in "ab" for i in range(5)]
    assert ranking.capped(df, "db", order).count() == 24
    assert ranking.capped(df, "db", order, questions=0).count() == 0 and ranking.capped(df, "db", order, databases=1).count() == 8
    with pytest.raises(ValueError):
        ranking.capped(df, "db", order, questions=-1)


def test_thresholds_given_with_rows(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (0.3,), (7.0,)], "t double")
    assert [r[0] for r in df.select(ranking.threshold_or_default(F.col("t"))).collect()] == [0.0, 0.5, 0.3, 1.0]


def test_keyword_tokens(spark):
    df = spark.createDataFrame([("List the country's schools, well-known schools and don't x2 Zürich schools.",), ("the of",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.keyword_query_tokens(F.col("t"))).collect()] == ["LIST OR SCHOOLS OR ZÜRICH", None, None, None]


def test_text_switch(spark):
    q = spark.createDataFrame([(1, "own", "other"), (2, "own", None)], "query_id long, text string, text_contains string")
    assert [tuple(r) for r in search.text_asked(q).collect()] == [(1, "own")]
    assert [tuple(r) for r in search.text_asked(q, send_contains=True).collect()] == [(1, "other")]


def test_metadata_statements(spark):
    df = spark.createDataFrame([("my table", "a", "it's\n one", "N/A"), ("t", "select it", None, " "), ("t", "b", "x", "y")], "table_name string, column_name string, description string, value_description string")
    got = sorted(r.statement for r in ddl.metadata_statements(df).collect())
    assert got == ["ALTER TABLE T MODIFY (B ANNOTATIONS (ADD value_description 'y'));", "COMMENT ON COLUMN \"MY TABLE\".A IS 'it''s one';", "COMMENT ON COLUMN T.B IS 'x';"]


def test_corpora(spark):
    columns = spark.createDataFrame([("o", "t", "TABLE", 1, "c", "int", None, "note"), ("o", "u", "TABLE", 1, None, "int", None, None)], corpus.SCHEMA)
    tables = spark.createDataFrame([("t", "about t", None)], "object_name string, comment_text string, annotation string")
    assert [r.search_text for r in corpus.unified_corpus(columns, tables).collect()] == ["o t c TABLE int note about t"]
    assert corpus.unified_corpus(columns).first().table_comment is None
    names = corpus.single_schema(spark.createDataFrame([("db", "t")], "db string, name string"), "db", "name")
    assert tuple(names.select("table_name", corpus.own_name(F.col("table_name"), F.col("db"))).first()) == ("DB_T", "T")


def test_description_encodings(spark, tmp_path):
    head = "original_column_name,column_name,column_description\n"
    (tmp_path / "utf.csv").write_bytes(b"\xef\xbb\xbf" + (head + 'é,,"two\nlines"\n').encode())
    (tmp_path / "latin.csv").write_bytes((head + "é,,ü\n,,x\n").encode("latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = readers.descriptions(spark, str(tmp_path)).collect()
    assert sorted((r.table_name, r.column_name, r.description) for r in rows) == [("latin", "é", "ü"), ("utf", "é", "two\nlines")]
    assert readers.descriptions(spark, str(tmp_path / "latin.csv"), "ISO-8859-1").count() == 1


def test_retrieval_pages(spark, tmp_path):
    rows = [(i, "d", "a <b> & c", ["x"], ["x", "y"], "broke" if i == 4 else None) for i in range(5)]
    df = evaluate.retrieval_metrics(spark.createDataFrame(rows, "question_id long, db_id string, question string, expected array<string>, found array<string>, error string"))
    mean = evaluate.retrieval_averages(df).first()
    assert (mean.questions, mean.failures, mean.p_at_3, mean.r_at_10) == (5, 1, 0.5, 1.0)
    writers.write_retrieval_pages(df, str(tmp_path / "out"), "A <run>", size=2)
    pages = {r.batch: r.value for r in spark.read.text(str(tmp_path / "out/batches"), wholetext=True).collect()}
    assert sorted(pages) == [0, 1, 2] and "a &lt;b&gt; &amp; c" in pages[0] and pages[0].count("<tr><td>") == 2 and "broke" in pages[2]
    full = "".join(r.value for r in spark.read.text(str(tmp_path / "out/full")).collect())
    assert "5 questions, 1 failed" in full and "0.5000" in full and full.count("batch=") == 3
