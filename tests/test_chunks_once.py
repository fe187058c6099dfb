"""Chunk search makes and tokenises its chunks once, whatever is computed from them; null texts count as they did."""

from lodestone.operators import search


def test_chunks_are_made_once(spark):
    docs = spark.createDataFrame([(1, "red house\nblue car. green car"), (2, None), (3, "red"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red car")], "query_id long, text string")
    found = search.chunk_search(asked, docs, aggregator="AVG")
    assert "posexplode" not in found._jdf.queryExecution().toString().lower()
    assert sorted((r.id, r.n_chunks, [c.chunk for c in r.chunks]) for r in found.collect()) == [(1, 2, [1, 0]), (3, 1, [0])]


def test_many_and_few_terms_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red house blue"), (2, None), (3, "red red car"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red car"), (2, "house")], "query_id long, text string")
    few = sorted(map(tuple, search.bm25(asked, docs).collect()))
    monkeypatch.setattr(search, "ROW_WISE_TERMS", 1)
    assert few and few == sorted(map(tuple, search.bm25(asked, docs).collect()))
