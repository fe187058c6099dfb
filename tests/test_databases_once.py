"""Runs by database go through their documents once; a keyword index shuffles blocks, not the counts that they are made of (F10)."""

import random

from pyspark.sql import functions as F
from test_inverted import ASKED, bm25, corpus, found, frame, shuffled

from lodestone.operators import inverted, observed, versions


def test_documents_are_read_once_whatever_the_databases(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(("a", "b/ =%", "", None)[i % 4], i, f"red house {i}x") for i in range(40)]
    docs = spark.createDataFrame(rows, "db_id string, id long, text string")
    questions = spark.createDataFrame([("a", 1, "red"), ("b/ =%", 2, "x 5x"), ("", 3, "house 6x"), ("none", 4, "red")], "db_id string, query_id long, text string")
    hits, times = observed.run_by_database(docs.mapInArrow(counted, docs.schema), questions, str(tmp_path / "runs"), 3)
    assert seen.value == len(rows)
    assert sorted((r.db_id, r.query_id, r.id, r["rank"]) for r in hits.collect()) == [("", 3, 2, 2), ("", 3, 6, 1), ("", 3, 10, 3), ("a", 1, 0, 1), ("a", 1, 4, 2), ("a", 1, 8, 3), ("b/ =%", 2, 5, 1)]
    assert {r.db_id: r.documents for r in times.collect()} == {"a": 10, "b/ =%": 10, "": 10, "none": 0}
    assert not list((tmp_path / "runs").glob("*"))


def test_blocks_are_shuffled_instead_of_counts(spark, tmp_path):
    docs = frame(spark, {i: " ".join(f"word{k}x" for k in range(20)) for i in range(600)}).cache()
    docs.count()
    before = shuffled(spark)
    inverted.build(docs, str(tmp_path / "i"))
    assert shuffled(spark) - before < 600 + 20 * 8 + 100  # documents, and a block for each word and window


def test_windows_stay_whole_over_arrow_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 16)
    docs, path = corpus(random.Random(8), 200), str(tmp_path / "i")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        inverted.build(frame(spark, docs), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = versions.segment_rows(spark, path, versions.latest(spark, path), "postings", inverted.POSTINGS)
    assert blocks.groupBy("term", "window").count().where("count > 1").count() == 0
    assert blocks.where((F.size("ids") != F.col("n")) | (F.array_max("tfs") != F.col("max_tf")) | (F.array_min("lens") != F.col("min_len")) | (F.sort_array("ids") != F.col("ids"))).count() == 0
    assert blocks.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] == sum(len(t.split()) for t in docs.values())
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)
