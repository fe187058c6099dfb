"""Edge rows, worked examples and parsers."""

import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, ddl, dialect, discover, evaluate, lineage, search, sweep
from lodestone.operators.ranking import normalised, top_n

ARRAYS = "expected array<string>, found array<string>"


def one(spark, expected, found, k=10):
    return evaluate.table_metrics(spark.createDataFrame([(expected, found)], ARRAYS), k=k).first()


@pytest.mark.parametrize(
    ("expected", "found", "want"),
    [
        ([], ["a"], {"recall_at_5": 1.0, "precision": 0.0, "recall": 0.0, "f1_at_1": 0.0, "hit_at_1": False, "jaccard": 0.0, "exact_match": False}),
        (["a"], [], {"precision": 0.0, "recall": 0.0, "mrr": 0.0, "hit_at_5": False, "jaccard": 0.0}),
        ([], [], {"jaccard": 1.0, "exact_match": True, "precision": 0.0, "f1": 0.0, "recall_at_3": 1.0}),
        (["A"], ["a"], {"precision": 1.0, "exact_match": True, "mrr": 1.0}),
        (["a", "b"], ["a", "A", "c"], {"precision_at_3": 0.5, "precision": 0.5}),
        (["A", "B", "C"], ["X", "A", "Y", "B", "C"], {"mrr": 0.5, "recall_at_3": 0.333333, "top_n_accuracy": 0.333333}),
        (["a", "b", "c"], ["a", "x", "y", "b", "z", "c"], {"recall_at_5": 0.666667, "recall_at_15": 1.0}),
        (None, None, {"jaccard": 1.0, "exact_match": True}),
    ],
)
def test_metric_edges(spark, expected, found, want):
    row = one(spark, expected, found).asDict()
    assert {k: row[k] for k in want} == want


def test_joint_and_macro_columns(spark):
    schema = "question_id long, expected array<struct<table:string,columns:array<string>>>, found array<struct<table:string,columns:array<string>>>"
    rows = [(1, [("A", ["X", "Y"]), ("B", ["Z"])], [("a", ["x", "w"])]), (2, [("A", ["X"]), ("A", ["X"])], [("A", ["X"])]), (3, [], [("A", ["X"])])]
    got = {r.question_id: r for r in evaluate.column_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].joint_precision, got[1].joint_recall) == (0.5, 0.333333)
    assert got[1].column_precision == 0.25 and got[1].column_recall == 0.25
    assert got[2].joint_recall == 1.0 and got[2].column_f1 == 1.0
    assert got[3].joint_f1 == 0.0 and got[3].column_top_n_accuracy == 0.0


def loop_top_n(scores, n):
    """Bounded insertion: a later row only replaces an earlier one if it is strictly better."""
    kept = []
    for i, s in enumerate(scores):
        if len(kept) < n:
            kept.append((s, i))
        elif s > kept[-1][0]:
            kept[-1] = (s, i)
        kept.sort(key=lambda x: (-x[0], x[1]))
    return [i for _, i in kept]


def test_top_n_is_the_bounded_insertion(spark):
    random.seed(5)
    cases = [[random.randint(0, 5) for _ in range(random.randint(1, 12))] for _ in range(60)]
    rows = [(g, i, float(s)) for g, c in enumerate(cases) for i, s in enumerate(c)]
    df = spark.createDataFrame(rows, "g int, i int, s double")
    got = {}
    for r in top_n(df, ["g"], [F.desc("s"), F.asc("i")], 3).collect():
        got.setdefault(r.g, {})[r.rank] = r.i
    assert all([got[g][k] for k in sorted(got[g])] == loop_top_n(c, 3) for g, c in enumerate(cases))
    with pytest.raises(ValueError, match="n must"):
        top_n(df, ["g"], [F.asc("i")], 0)


def test_normalised_single_and_equal(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 3.0), (3, 2.0)], "q int, s double")
    assert sorted(r.n for r in df.select(normalised(F.col("s"), ["q"]).alias("n")).collect()) == [0.0, 0.5, 1.0, 1.0, 1.0, 1.0]


def test_discovery_strategies(spark):
    objects = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (1, "c", 0.1)], "query_id long, obj string, score double")
    columns = spark.createDataFrame([(1, 10, "a", 0.8), (1, 11, "a", 0.6), (1, 12, "z", 0.95), (1, 13, "b", 0.2)], "query_id long, id long, obj string, score double")
    seq = discover.sequential(objects, columns, "obj", k=5, k0=3, n=10, cols_per_obj=1, threshold=0.5).orderBy("rank").collect()
    assert [(r.obj, r.score) for r in seq] == [("a", 0.865), ("b", 0.455)] and seq[0].columns == [10] and seq[1].columns is None
    par = discover.parallel(objects, columns, "obj", k=2, m=4, cols_per_obj=2).orderBy("rank").collect()
    assert [r.obj for r in par] == ["a", "z"] and par[1].score == 0.4
    uni = discover.unified(columns, "obj", k=2, m=4, cols_per_obj=2, threshold=0.5).orderBy("rank").collect()
    assert [(r.obj, r.score) for r in uni] == [("z", 1.0), ("a", 0.666667)]
    with pytest.raises(ValueError, match="thresholds"):
        discover.unified(columns, "obj", k=2, threshold=60)


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 5, 1)]
    corpus_ = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    queries = corpus_.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    whole = sorted(map(tuple, search.vector_search(queries, corpus_, 4, group="label").collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "CORPUS_BLOCK", 7)
    assert sorted(map(tuple, search.vector_search(queries, corpus_, 4, group="label").collect())) == whole
    assert not search.vector_search(queries.where("false"), corpus_, 4).count()


def test_fusion_modes(spark):
    v = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], "query_id long, id long, score double")
    k = spark.createDataFrame([(1, 2, 5.0), (1, 3, 4.0)], "query_id long, id long, score double")
    get = lambda s, f: {r.id: r.score for r in search.fuse(v, k, s, f, 1, 1, 5, 1).collect()}
    assert get("RSF", "UNION") == {1: 0.5, 2: 0.5, 3: 0.0} and get("RSF", "INTERSECT") == {2: 0.5} and get("RSF", "RERANK") == {2: 0.0, 3: 0.0}
    assert get("RRF", "UNION")[2] == round(1 / 7 + 1 / 2, 6)
    with pytest.raises(ValueError, match="unknown"):
        get("X", "UNION")


def test_text_functions(spark):
    df = spark.createDataFrame([("list the within of",), ("Show Total total Schools",), (None,)], "q string")
    assert [r[0] for r in df.select(T.keyword_query(F.col("q"))).collect()] == [None, "SHOW OR TOTAL OR SCHOOLS", None]
    pairs = "array<struct<name:string,value:string>>"
    rows = [([("n", " v  w ")], "[x]"), ([(None, "v")], "[x]"), ([("n", None)], '[{"n"}]'), ([], "[]"), (None, None)]
    notes = spark.createDataFrame(rows, f"p {pairs}, raw string").select(T.annotation_text(F.col("p"), F.col("raw"))).collect()
    assert [r[0] for r in notes] == ["n: v w", "v", '[{"n"}]', "[]", None]
    words = spark.createDataFrame([(["w"] * n,) for n in (0, 1, 100, 101, 191)], "w array<string>").select(F.transform(T.chunks(F.col("w")), lambda c: F.size(c))).collect()
    assert [r[0] for r in words] == [[], [1], [100], [100, 11], [100, 100, 11]]


def test_upsert_replace_and_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, corpus.upsert(base, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert corpus.duplicate_keys(base.union(base), ["id"]).count() == 2
    assert [r.id for r in corpus.foreign_key_orphans(new, "id", base, "id").collect()] == [3]


def test_dialect_leaves_quotes_alone(spark):
    assert dialect.to_spark("SELECT 'IFNULL(a, b)', \"Free (K-12)\" FROM t -- IIF(a,b,c)") == "SELECT 'IFNULL(a, b)', `Free (K-12)` FROM t -- IIF(a,b,c)"
    assert spark.sql(dialect.to_spark("SELECT IFNULL(NULL, 3) AS a, IIF(1 > 0, 'x', 'y') AS b, 'a.b' GLOB 'a.?' AS c, 'axb' GLOB 'a.?' AS d")).first() == (3, "x", True, False)
    with pytest.raises(ValueError, match="unbalanced"):
        dialect.to_spark("SELECT IFNULL(a")


def test_lineage_modes(spark):
    sql = "SELECT T1.a, `b c` FROM x AS T1 JOIN y T2 ON T1.id = T2.id WHERE kind = 'from z'"
    assert lineage.columns_of(sql) == {"x": ["a", "b c", "id", "kind"], "y": ["id"]}
    tables, columns = lineage.catalyst_relations(spark, sql)
    assert tables == ["x", "y"] and "T1.a" in columns
    nested = "WITH x AS (SELECT a FROM t), `y` (b) AS (SELECT a FROM x) SELECT b FROM y"
    assert lineage.tables_of(nested)[0] == ["t"] and lineage.catalyst_relations(spark, nested)[0] == ["t"]


def test_dates_and_formats_run(spark):
    said = "SELECT strftime('%W', DATE'2023-01-01'), strftime('%Y-%W', DATE'2023-01-02'), strftime('%j|%H', TIMESTAMP'2024-12-31 05:06:07'), strftime('day %d', DATE'2024-02-03'), printf('%d', 1.5), CAST(date('2024-03-01', '-1 day') AS STRING), strftime('%s', TIMESTAMP'1970-01-02 00:00:00')"
    assert tuple(spark.sql(dialect.to_spark(said)).first()) == ("00", "2023-01", "366|05", "day 03", "1", "2024-02-29", "86400")


def test_column_metrics_with_repeated_and_missing_tables(spark):
    kind = "array<struct<table:string,columns:array<string>>>"
    rows = [(1, [("A", ["X", "Y"]), ("B", ["Z"])], [("A", ["X", "W"])]), (2, [("A", ["x"]), ("a", ["y"])], [("a", ["Y"]), ("A", ["x"])]), (3, None, [("a", ["b"])]), (4, [("a", [])], None)]
    got = {r.question_id: r for r in evaluate.column_metrics(spark.createDataFrame(rows, f"question_id int, expected {kind}, found {kind}")).collect()}
    assert (got[1].joint_precision, got[1].joint_recall, got[1].column_recall) == (0.5, 0.333333, 0.25)
    assert (got[2].joint_precision, got[2].joint_recall, got[2].column_precision, got[2].column_top_n_accuracy) == (0.5, 0.5, 1.0, 1.0)
    assert {got[i][c] for i in (3, 4) for c in got[i].asDict() if c != "question_id"} == {0.0}


def test_keyword_paths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "big red house and big garden"), (2, "red 12 of the"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the big red thing"), (8, "of the"), (9, None)], "query_id long, text string")
    both = [sorted(map(tuple, f(asked, docs).collect())) for f in (search.keyword_overlap, search.bm25)]
    monkeypatch.setattr(search, "ROW_WISE_TERMS", 0)
    assert both == [sorted(map(tuple, f(asked, docs).collect())) for f in (search.keyword_overlap, search.bm25)] and len(both[0]) == 2


def test_ddl_strings_and_comments():
    t = ddl.parse_create("CREATE TABLE t (a TEXT DEFAULT 'x, (y', -- b, c\n b INT CHECK (b > 0), PRIMARY KEY (a, b))")
    assert [c.name for c in t.columns] == ["a", "b"] and t.primary_key == ["a", "b"] and t.columns[0].default == "'x, (y'" and t.checks == ["b>0"]
    assert ddl.comment_statement("t", "a", "it's") == "COMMENT ON COLUMN t.a IS 'it''s';"
    assert ddl.default_value("'0000-00-00'") == "NULL"


def test_sweeps():
    assert len(sweep.expand({"modes": ["unified", "parallel"], "search_types": ["vector"]})) == 2
    with pytest.raises(ValueError, match="sweeps"):
        sweep.expand({"modes": ["sequential"]})
    assert sweep.resolved({"k": 5}, {"k": None, "alpha": 0.1})["k"] == 5
    with pytest.raises(ValueError, match="score_threshold"):
        sweep.resolved({"score_threshold": 60})
    assert sweep.parse_config('# c\n{"modes": ["unified"]}') == {"modes": ["unified"]}
    assert sweep.result_path("r", "csv", {"mode": "unified", "search_type": "hybrid", "scorer": "RSF", "dataset_form": "one", "text_score_weight": 2.0}) == "r/csv/unified/hybrid/RSF/one/text_score_weight=2"


def test_qualified_tables_and_moments(spark):
    assert lineage.tables_of("SELECT a FROM db.t1 x JOIN s.db.t2 ON x.a = t2.b")[0] == ["t1", "t2"]
    assert lineage.columns_of("SELECT x.a FROM db.t1 AS x")["t1"] == ["a"]
    moved = lambda sql: spark.sql(dialect.to_spark(f"SELECT date({sql}) AS d")).first().d.isoformat()
    assert moved("'2024-01-31', '+1 month'") == "2024-03-02" and moved("'2024-02-29', '-1 year'") == "2023-03-01" and moved("'2023-01-31', '+1 month', 'start of month'") == "2023-03-01"
    assert moved("'2024-05-05', 'localtime'") == moved("'2024-05-05', 'utc'") == "2024-05-05"  # the session is in UTC
    assert spark.sql(dialect.to_spark("SELECT date('now', 'localtime') AS d")).first().d


def test_rows_of_a_function(spark):
    from lodestone.operators.perrow import flat_rows

    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k int, t string")
    got = flat_rows(df, "t", lambda t: [(w, len(w)) for w in t.split()], "word string, n int")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 1)]


def test_foreign_keys_are_numbered_over_all_statements(spark):
    df = spark.createDataFrame([(2, "CREATE TABLE t (a INT REFERENCES x (i))"), (1, "CREATE TABLE T (b INT, c INT, FOREIGN KEY (b) REFERENCES y (j), FOREIGN KEY (c) REFERENCES z (k))")], "n int, SQL string")
    assert sorted((r.constraint_name, r.columns) for r in ddl.foreign_keys(df, "n").collect()) == [("FK_T_1", "b"), ("FK_T_2", "c"), ("FK_T_3", "a")]
