"""Refreshing and deleting in a keyword index costs in proportion to what documents hold (F1)."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_inverted import ASKED, bm25, corpus, found, frame, shuffled

from lodestone.operators import inverted, versions


def test_terms_are_sorted_once_a_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],)], "terms array<string>").select(inverted._counted(F.sort_array("terms")).alias("c"))
    assert rows._jdf.queryExecution().analyzed().toString().count("sort_array(") == 1  # within a lambda it would run for every term
    assert [tuple(x) for x in rows.first()[0]] == [("a", 1), ("b", 2)]


def test_long_documents_are_counted(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    got = spark.createDataFrame([(words,)], "terms array<string>").select(F.inline(inverted._counted(F.sort_array("terms")))).collect()
    assert {r.term: r.tf for r in got} == {w: words.count(w) for w in set(words)}


def test_a_long_document_is_deleted_soon(spark, tmp_path):
    path, words = str(tmp_path / "i"), [f"w{k}" for k in range(30_000)]
    inverted.build(frame(spark, {1: " ".join([*words, *words[:100]]), 2: "w1 w1 w2", 3: "w1"}), path)
    began = time.monotonic()
    inverted.delete(spark.createDataFrame([(1,), (2,)], "id long"), path)
    assert time.monotonic() - began < 60  # sorting its terms anew for each of them took minutes
    (marker, _), = versions.latest(spark, path).markers
    less = {r.term: r.n for r in spark.read.parquet(f"{path}/{marker}/less").collect()}
    assert len(less) == 30_000 and (less["w1"], less["w2"], less["w3"]) == (2, 2, 1)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_compaction_takes_stored_terms(spark, tmp_path, monkeypatch, few):
    """Few marked ids go to where the documents are: documents are not shuffled, and their terms are not made anew."""
    monkeypatch.setattr(versions, "SENT_IDS", few)
    monkeypatch.setattr(inverted, "WINDOW", 16)
    docs, path = corpus(random.Random(3), 400), str(tmp_path / "i")
    inverted.build(frame(spark, docs), path)
    new = {i: t for i, t in zip(range(380, 440), corpus(random.Random(4), 60).values(), strict=True)}
    inverted.refresh(frame(spark, new), path)
    inverted.delete(spark.createDataFrame([(i,) for i in range(0, 440, 10)] * 2, "id long"), path)
    inverted.refresh(frame(spark, {10: "waa wll"}), path)
    docs = {i: t for i, t in (docs | new).items() if i % 10} | {10: "waa wll"}
    monkeypatch.setattr(inverted.T, "index_terms", None)
    inverted.compact(spark, path)
    monkeypatch.undo()
    now = versions.latest(spark, path)
    assert (len(now.segments), now.markers, now.totals["docs"]) == (1, (), len(docs))
    stored = versions.segment_rows(spark, path, now, "docs", inverted.DOCS)
    assert {r.id: list(r.terms) for r in stored.collect()} == {i: t.split() for i, t in docs.items()}
    assert stored.groupBy("window").count().agg(F.max("count")).first()[0] <= 16
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)


def test_documents_stay_where_they_are_marked_and_compacted(spark, tmp_path):
    path, n = str(tmp_path / "i"), 3000
    inverted.build(frame(spark, {i: f"same word{i % 7}x" for i in range(n)}), path)
    before = shuffled(spark)
    inverted.delete(spark.createDataFrame([(i,) for i in range(30)], "id long"), path)
    inverted.compact(spark, path)
    assert shuffled(spark) - before < n / 2  # ids, counts and blocks; before, documents were shuffled three times
