"""Metrics from counts give what metrics over lists give; fields of result and summary files."""

import random

from pyspark.sql import functions as F

from lodestone.operators import evaluate

NAMES = [f"n{i}" for i in range(9)]


def test_counts_and_lists_agree(spark):
    rng = random.Random(5)
    rows = [(q, rng.sample(NAMES, rng.randint(0, 9)) + rng.choices(NAMES, k=rng.randint(0, 2)), [x.upper() if rng.random() < 0.3 else x for x in rng.choices(NAMES, k=rng.randint(0, 12))]) for q in range(120)]
    rows += [(500, [], []), (501, ["n1"], []), (502, [], ["n1"])]
    lists = spark.createDataFrame(rows, "question_id int, expected array<string>, found array<string>")
    questions = lists.select("question_id", F.size(F.array_distinct("expected")).alias("n_expected"))
    found = lists.select("question_id", "expected", F.posexplode("found").alias("p", "name"))
    found = found.select("question_id", (F.col("p") + 1).alias("rank"), "name", F.array_contains("expected", F.lower("name")).alias("hit"))
    got = evaluate.counted_metrics(questions, found, k=4)
    want = evaluate.table_metrics(lists, k=4).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "ArrayType" not in got.schema.simpleString() and "collect_list" not in got._jdf.queryExecution().toString()


def test_fields(spark):
    kind = "array<struct<table:string,columns:array<string>>>"
    rows = [(1, "A", "q", 12.5, None, [("T", ["x", "y"]), ("U", ["z"])], [("T", ["x"]), ("V", ["w"])]), (2, "a", "r", 7.5, None, [("T", ["x"])], None), (3, "a", "s", 1.0, "failed", None, [("T", None)])]
    df = spark.createDataFrame(rows, f"question_id int, db_id string, question string, execution_time_ms double, error string, expected {kind}, found {kind}")
    got = evaluate.result_rows(df)
    assert len(got.columns) == 52 and got.columns[:10] == evaluate.RESULT_HEAD and got.columns[-1] == "error"
    first = {r.question_id: r for r in got.collect()}
    assert (first[1].num_expected_tables, first[1].num_expected_columns, first[1].expected_columns, first[1].discovered_columns) == (2, 3, ["T.x", "T.y", "U.z"], ["T.x", "V.w"])
    assert (first[1].table_precision, first[1].joint_column_recall, first[3].discovered_columns, first[2].table_mrr) == (0.5, 0.333333, [], 0.0)
    summary = evaluate.summary_rows(got)
    assert len(summary.columns) == 46
    r = summary.first()
    assert (r.db_id, r.total_questions, r.successful_queries, r.failed_queries, r.avg_execution_time_ms, r.avg_table_precision, r.table_hit_at_1_rate) == ("a", 3, 2, 1, 10.0, 0.25, 0.5)
