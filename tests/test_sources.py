"""Readers, writers, model interfaces and streams."""

import datetime
import json
import sqlite3

from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.sources import models, readers, writers


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "SELECT 1", "database_name": "d", "question": "q"}\n{"SQL": "SELECT 2", "db_id": "d", "question_id": 7}\n')
    rows = readers.questions(spark, str(tmp_path / "q.jsonl"), lines=True).orderBy("SQL").collect()
    assert [(r.question_id, r.db_id, r.SQL) for r in rows] == [(0, "d", "SELECT 1"), (7, "d", "SELECT 2")]
    (tmp_path / "q.json").write_text(json.dumps([{"SQL": "SELECT 3", "db_id": "e"}]))
    assert readers.questions(spark, str(tmp_path / "q.json")).first().SQL == "SELECT 3"


def test_descriptions_and_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("original_column_name,column_name,column_description\na,b,\"x, y\"\n,c,z\n,,w\n")
    rows = readers.descriptions(spark, str(tmp_path / "t.csv")).orderBy("column_name").collect()
    assert [(r.table_name, r.column_name, r.description) for r in rows] == [("t", "a", "x, y"), ("t", "c", "z")]
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE b (x INT)")
        db.execute("CREATE TABLE a (y TEXT)")
    assert [r.table_name for r in readers.sqlite_schema(spark, str(tmp_path / "x.db")).collect()] == ["a", "b"]


def test_scripts(spark, tmp_path):
    text = "-- c;\nCREATE TABLE t (a TEXT DEFAULT ';');\n\nCREATE OR REPLACE PROCEDURE p IS BEGIN x; y; END;\n/\nSELECT 1"
    assert readers.split_script(text) == ["CREATE TABLE t (a TEXT DEFAULT ';')", "CREATE OR REPLACE PROCEDURE p IS BEGIN x; y; END;", "SELECT 1"]
    (tmp_path / "s.sql").write_text(text)
    assert readers.scripts(spark, str(tmp_path / "s.sql")).count() == 3


def test_prompt_dumps(spark):
    text = lambda *t: [{"type": "text", "text": x} for x in t]
    dump = [
        {"role": "SYSTEM", "content": text("create table zero")},
        {"role": "SYSTEM", "content": text('x CREATE TABLE "S"."Alpha" (x) create table no', "create  table s.beta (", "nothing", 'CREATE TABLE "s"."ALPHA"')},
        {"role": "ASSISTANT", "content": text("create table no")}, {"role": "SYSTEM", "content": None}, {"role": "SYSTEM", "content": [{"type": "image", "text": "create table no"}]},
        {"role": "USER", "content": text("create table no")}, {"role": "SYSTEM", "content": text("create table late")},
    ]
    rows = readers.prompt_dumps(spark.createDataFrame([(json.dumps(dump),), (None,), ("[]",), ("no json",)], "payload string")).collect()
    assert [r.tables for r in rows] == [["Alpha", "beta"], [], [], []]


def test_lineage_by_model(spark):
    def client(prompts):
        return [("no json", 3) if "FROM bad" in p else ('ok {"tables": [{"name": "`s`.t", "columns": ["t.a", "select"]}]}', 5) for p in prompts]

    df = spark.createDataFrame([(1, "SELECT a FROM t"), (2, "SELECT b FROM bad"), (3, None)], "id int, SQL string")
    rows = {r.id: r for r in models.extract_lineage(df, client).collect()}
    assert rows[1].method == "llm" and json.loads(rows[1].tables) == [{"name": "t", "columns": [{"name": "a"}]}]
    assert rows[2].method == "rule" and rows[2].tokens == 6 and json.loads(rows[2].tables) == [{"name": "bad", "columns": [{"name": "b"}]}]


def test_embedding_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("alpha beta alpha",), ("",), (None,)], "text string").withColumn("v", models.hashed_embedding(F.col("text"), 8))
    rows = df.collect()
    assert sum(abs(x) for x in rows[0].v) in (1.0, 3.0) and set(rows[1].v) == {0.0}
    table = spark.createDataFrame([("d<b", 0.9, 1.234, ["a", "b"], "q" * 300)], "db_id string, avg_f1 double, time_ms double, names array<string>, question string")
    writers.write_csv(table, str(tmp_path / "out"))
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (got.avg_f1, got.time_ms, got.names, len(got.question)) == ("0.9000", "1.23", "a|b", 200)
    page = writers.dashboard(table, {"f1": 0.9}, "A <run>")
    assert "A &lt;run&gt;" in page and "d\\u003cb" in page
    assert [writers.grade(x) for x in (0.8, 0.5, 0.4, None)] == ["good", "fair", "poor", "poor"]


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=20 * i), i % 2, "click", 1.0) for i in range(9)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_events(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT * FROM hours").collect()) == [3, 3, 3]
    corpus = str(tmp_path / "corpus-")
    spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string").write.parquet(corpus + "0")
    spark.createDataFrame([(2, "x", 1), (2, "new", 2), (3, "new", 1)], "id int, v string, changed_at int").coalesce(1).write.parquet(str(tmp_path / "changes"))
    latest = [corpus + "0"]

    def write(df, epoch):
        df.write.parquet(f"{corpus}{epoch + 1}")
        latest.append(f"{corpus}{epoch + 1}")

    changes = spark.readStream.schema("id int, v string, changed_at int").parquet(str(tmp_path / "changes"))
    streaming.refresh_corpus(changes, lambda: spark.read.parquet(latest[-1]), write, "id", str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(latest[-1]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
