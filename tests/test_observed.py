"""Runs by database: hits, observed counts and times; object texts with comments."""

from pyspark.sql import functions as F

from lodestone.operators import corpus, observed


def test_databases_have_indexes_and_times_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "red house"), ("a", 2, "blue house"), ("b", 1, "red car"), (None, 9, "red")], "db_id string, id long, text string")
    questions = spark.createDataFrame([("a", 1, "red house"), ("a", 2, "car"), ("b", 3, "red"), ("c", 4, "red"), (None, 5, "red")], "db_id string, query_id long, text string")
    hits, times = observed.run_by_database(docs, questions, str(tmp_path / "runs"), 5)
    assert sorted((r.db_id, r.query_id, r.id, r["rank"]) for r in hits.collect()) == [("a", 1, 1, 1), ("a", 1, 2, 2), ("b", 3, 1, 1)]
    rows = {r.db_id: r for r in times.collect()}
    assert {k: (r.documents, r.questions, r.hits) for k, r in rows.items()} == {"a": (2, 2, 2), "b": (1, 1, 1), "c": (0, 1, 0)}
    assert all(r.setup_ms > 0 and abs(r.avg_execution_time_ms * r.questions - r.search_ms) < 1e-6 for r in rows.values())
    total = observed.setup_time(times).first()
    assert total.databases == 3 and abs(total.setup_ms - sum(r.setup_ms for r in rows.values())) < 1e-6
    assert abs(total.avg_execution_time_ms - sum(r.search_ms for r in rows.values()) / 4) < 1e-6
    assert not list((tmp_path / "runs").glob("*"))  # indexes are taken down


def test_no_databases(spark, tmp_path):
    none = spark.createDataFrame([], "db_id string, query_id long, text string")
    hits, times = observed.run_by_database(none.withColumnRenamed("query_id", "id"), none, str(tmp_path))
    assert hits.count() == 0 and observed.setup_time(times).first().databases == 0


def test_objects_with_comments(spark):
    columns = spark.createDataFrame([("o", "T", "VIEW", 2, "b"), ("o", "T", "VIEW", 1, "a"), ("o", "U", "TABLE", 1, "c")], "owner string, object_name string, object_type string, pos int, column_name string")
    tables = spark.createDataFrame([("T", "about t", None)], "object_name string, comment_text string, annotation string")
    assert sorted(r.search_text for r in corpus.object_corpus(columns, tables).collect()) == ["T o VIEW about t a b", "U o TABLE c"]
    assert sorted(r.search_text for r in corpus.object_corpus(columns).collect()) == ["T o VIEW a b", "U o TABLE c"]
    assert corpus.object_corpus(columns, tables.where(F.lit(False))).count() == 2
