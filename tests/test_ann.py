"""The vector index: recall for each metric, what is read, replaced and deleted rows, filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, search, versions


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors of different lengths around a dozen centres."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.6, (150, 10)) for c in rng.normal(0, 1, (12, 10))]) * rng.uniform(0.5, 2, (1800, 1))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (None, x[0].tolist())], "id long, vector array<double>").cache()


def asked(rows):
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@pytest.mark.parametrize("metric", ann.METRICS)
def test_recall_and_rows_that_are_read(spark, tmp_path, rows, metric):
    path = str(tmp_path / "i")
    ann.build(rows.where("id < 1500 OR id IS NULL"), path, metric)
    ann.refresh(rows.where("id >= 1400"), path)  # a hundred known ids
    s = ann.searched(asked(rows), path, 10, scan=0.3, rescore=90, metric=metric)
    assert s.total == 1800
    found = s.hits.collect()
    assert len({(r.query_id, r.id) for r in found}) == len(found) == 900
    assert ann.recall(s.hits, search.vector_search(asked(rows), rows.where("id IS NOT NULL"), 10, metric)).first().recall >= 0.9
    worst = s.report().agg(F.max("vectors").alias("vectors"), F.max("share").alias("share"), F.max("codes").alias("codes")).first()
    assert worst.vectors <= 90 and worst.share <= 0.05 and worst.codes <= 0.5 * 1800
    with pytest.raises(ValueError, match="this index is for"):
        ann.search(asked(rows), path, 10, metric="l2" if metric != "l2" else "dot")


def test_all_cells_and_candidates_give_the_exact_rows(spark, tmp_path, rows):
    path = str(tmp_path / "i")
    some = rows.where("id < 300")
    ann.build(some, path, cells=9)
    got = sorted(map(tuple, ann.search(asked(some), path, 10, scan=1, rescore=300).select("query_id", "id", "score").collect()))
    assert got == sorted(map(tuple, search.vector_search(asked(some), some, 10).select("query_id", "id", "score").collect()))


def test_versions(spark, tmp_path, rows):
    path = str(tmp_path / "i")
    ann.build(rows.where("id < 200"), path)
    with pytest.raises(ValueError, match="there is an index"):
        ann.build(rows.where("id < 200"), path)
    query = rows.where("id = 7").select(F.lit(-5).alias("query_id"), "vector")
    best = lambda: ann.search(query, path, 1, scan=1, rescore=200).first().id
    assert best() == 7
    ann.refresh(rows.where("id = 9").select(F.lit(7).alias("id"), "vector"), path)  # 7 moves to where 9 is
    assert best() != 7
    ann.refresh(rows.where("id = 7"), path)
    assert best() == 7
    ann.delete(spark.createDataFrame([(7,), (7,), (5000,)], "id long"), path)
    assert best() != 7
    files = len(list((tmp_path / "i").iterdir()))
    assert versions.clean(spark, path) == 0 and len(list((tmp_path / "i").iterdir())) == files
    ann.drop(spark, path)
    assert not (tmp_path / "i").exists()


@pytest.mark.parametrize("part", [100, 10, 2])
def test_filters_leave_enough_rows(spark, tmp_path, rows, part):
    path = str(tmp_path / "i")
    some = rows.where("id < 1000")
    ann.build(some, path)
    good = some.where(F.col("id") % part == 0).select("id")
    found = ann.search(asked(some), path, 10, scan=0.3, only=good)
    exact = search.vector_search(asked(some), some.join(good, "id", "left_semi"), 10)
    assert ann.recall(found, exact).first().recall >= 0.9
    assert not found.where(F.col("id") % part != 0).count()


def test_odd_input(spark, tmp_path, rows):
    none = rows.where("id IS NULL AND vector IS NULL")
    with pytest.raises(ValueError, match="fitted on some rows"):
        ann.build(none, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="different lengths"):
        ann.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>"), str(tmp_path / "b"))
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 0.0])], "id long, vector array<double>")
    ann.build(same, str(tmp_path / "c"))
    got = ann.search(same.where("id = 3").select(F.col("id").alias("query_id"), "vector"), str(tmp_path / "c"), 5, scan=1, rescore=30).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.id)] == [0, 1, 2, 4, 5] and {r.score for r in got} == {1.0}
    assert ann.search(none.select(F.col("id").alias("query_id"), "vector"), str(tmp_path / "c"), 5).collect() == []


def test_recall_where_rows_have_no_clusters(spark, tmp_path):
    """Many rows without clusters: their codes must tell near ones apart well enough for few candidates."""
    x = np.random.default_rng(11).normal(0, 1, (6000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").cache()
    few = rows.where("id % 60 = 0").select(F.col("id").alias("query_id"), "vector")
    path = str(tmp_path / "i")
    ann.build(rows, path)
    found = ann.search(few, path, 10, scan=1, rescore=20)
    assert ann.recall(found, search.vector_search(few, rows, 10)).first().recall >= 0.9
