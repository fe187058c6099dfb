"""Column metrics and result rows come from one pass over a row's lists, without shuffles and joins of their own."""

from lodestone.operators import evaluate
from lodestone.plans import registry

KIND = "array<struct<table:string,columns:array<string>>>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_add_no_shuffle(spark):
    rows = [(1, "A", "q", 12.5, None, [("T", ["x", "y"]), ("U", ["z"])], [("t", ["X"]), ("V", ["w"])])]
    df = spark.createDataFrame(rows, f"question_id int, db_id string, question string, execution_time_ms double, error string, expected {KIND}, found {KIND}")
    for made in (evaluate.column_metrics(df), evaluate.result_rows(df)):
        assert "Exchange" not in _plan(made) and "Join" not in _plan(made) and made.count() == 1
    r = evaluate.column_metrics(df).first()
    assert (r.joint_precision, r.joint_recall, r.column_precision, r.column_recall_at_1, r.column_top_n_accuracy) == (1.0, 0.333333, 0.5, 0.25, 0.25)


def test_orders_are_read_and_dealt_once(spark):
    plan = _plan(registry.QUERIES["result_fields"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 3 and plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_orderkey, p_brand" not in plan
