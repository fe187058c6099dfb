"""The stored keyword index against scoring everything; versions against readers and other writers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted, search, sweep, versions
from lodestone.plans import retrieval

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]


def corpus(rng, n, words=WORDS):
    weights = [1 / (k + 1) for k in range(len(words))]
    return {i: " ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for i in range(n)}


def bm25(docs, asked, top):
    split = {i: t.split() for i, t in docs.items()}
    average = sum(map(len, split.values())) / max(len(split), 1)
    df = Counter(w for own in split.values() for w in set(own))
    out = []
    for q, text in asked.items():
        scored = []
        for i, own in split.items():
            tf = Counter(own)
            terms = set(text.split()) & set(own)
            if terms:
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / average)) for w in terms)
                scored.append((-round(s, 6), i))
        out += [(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, text string")


def found(spark, path, asked, top):
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    return sorted((r.query_id, r.id, r.rank) for r in inverted.search(queries, path, top).collect())


ASKED = {1: "waa wab", 2: "wkc wfd wab", 3: "wll", 4: "nothing here", 5: ""}


def test_refresh_delete_compact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 16)
    rng, path = random.Random(2), str(tmp_path / "i")
    docs = corpus(rng, 300)
    inverted.build(frame(spark, docs), path)
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)
    with pytest.raises(ValueError, match="there is an index"):
        inverted.build(frame(spark, docs), path)
    new = {i: t for i, t in zip(range(250, 340), corpus(rng, 90).values(), strict=True)}
    inverted.refresh(frame(spark, new), path)
    docs |= new
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)
    inverted.delete(spark.createDataFrame([(i,) for i in [*range(0, 340, 3), 999, 999]], "id long"), path)
    inverted.refresh(frame(spark, {3: "wll waa", 251: "wll"}), path)
    docs = {i: t for i, t in docs.items() if i % 3} | {3: "wll waa", 251: "wll"}
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)
    before = versions.latest(spark, path)
    inverted.compact(spark, path)
    assert found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)
    now = versions.latest(spark, path)
    assert (now.version, len(now.segments), now.markers, now.totals["docs"]) == (before.version + 1, 1, (), len(docs))
    assert versions.clean(spark, path) >= 4 and found(spark, path, ASKED, 7) == bm25(docs, ASKED, 7)


def test_blocks_are_skipped_and_results_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 16)
    rng, path = random.Random(4), str(tmp_path / "i")
    # The rare word is in a few neighbours only, the common one everywhere.
    docs = {i: f"common {'rare rare' if 100 <= i < 130 else ''} {rng.choice(WORDS)} {rng.choice(WORDS)}" for i in range(2000)}
    inverted.build(frame(spark, docs), path)
    asked = {1: "common rare"}
    s = inverted.searched(spark.createDataFrame(list(asked.items()), "query_id long, text string"), path, 10)
    r = s.report().first()
    assert sorted((x.query_id, x.id, x.rank) for x in s.hits.collect()) == bm25(docs, asked, 10)
    assert r.blocks >= 120 and r.read_first + r.read_after < r.blocks / 10
    text = s.hits._jdf.queryExecution().toString()
    assert "terms" not in text.split("Physical Plan")[-1]  # forward lists stay unread


def test_only_asked_folders_and_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(frame(spark, corpus(random.Random(5), 50)), path)
    heads = versions.segment_rows(spark, path, versions.latest(spark, path), "postings", inverted.POSTINGS).select("bucket", "term", "n").where("bucket = 3 AND term = 'waa'")
    text = heads._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "PartitionFilters: [isnotnull(bucket" in text and "ids:" not in text and "EqualTo(term,waa)" in text


def test_same_as_the_search_without_an_index(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = corpus(random.Random(6), 200) | {900: ""}  # in the index a null text is an empty one
    inverted.build(frame(spark, docs | {900: None}).union(spark.createDataFrame([(None, "waa")], "id long, text string")), path)
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, text string")
    want = {(r.query_id, r.id): r.score for r in search.bm25(queries, frame(spark, docs), "id").collect()}
    got = {(r.query_id, r.id): r.score for r in inverted.search(queries, path, 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, text string")
    assert inverted.search(queries, str(tmp_path / "no"), 5).collect() == []
    inverted.build(none, str(tmp_path / "i"))
    assert inverted.search(queries, str(tmp_path / "i"), 5).collect() == []


def test_readers_keep_their_version_and_writers_exclude_each_other(spark, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(frame(spark, {1: "waa", 2: "wab"}), path)
    old = inverted.search(spark.createDataFrame([(1, "waa")], "query_id long, text string"), path, 5)
    now = versions.latest(spark, path)
    inverted.refresh(frame(spark, {1: "wab"}), path)
    assert [r.id for r in old.collect()] == [1]  # planned before: still the version of then
    assert found(spark, path, {1: "waa"}, 5) == [] and [i for _, i, _ in found(spark, path, {1: "wab"}, 5)] == [1, 2]
    with pytest.raises(RuntimeError, match="claimed"):
        versions.publish(spark, path, now.after("late"))
    assert versions.latest(spark, path).segments[-1] != "late"


def test_a_sweep_searches_once_whatever_its_runs(spark):
    path = "/root/testdata/sf0.001"
    sizes = []
    for weights in ([1], [1, 2, 3, 4, 5, 6]):
        matrix = {"modes": ["parallel"], "search_types": ["hybrid"], "scorer_overrides": {"RSF": {"discover_text_score_weight": weights}}}
        text = retrieval.sweep_runs(spark, path, matrix)._jdf.queryExecution().toString().split("Physical Plan")[-1]
        sizes.append((text.count("Window ["), text.count("Scan"), text.count("Join")))
    assert sizes[0] == sizes[1]


def test_expanded_runs_resolve(spark):
    matrix = {"modes": ["unified", "parallel"], "search_types": ["vector", "hybrid"], "hybrid_scorers": ["RSF", "RRF"], "common": {"discover_k": 15}, "scorer_overrides": {"RRF": [{"discover_text_rank_penalty": 2}]}}
    runs = [sweep.resolved(r) for r in sweep.expand(matrix)]
    assert len(runs) == 6 and all(r["k"] == 15 for r in runs) and [r["text_rank_penalty"] for r in runs if r["scorer"] == "RRF"] == [2, 2]
    with pytest.raises(ValueError, match="sets"):
        sweep.variants([1])


def shuffled(spark) -> int:
    """Rows that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_that_are_shuffled(spark, tmp_path):
    """A build shuffles each document and each of its different terms once; a search shuffles blocks of asked terms only."""
    path, n = str(tmp_path / "i"), 600
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k} word{i}x{k}" for k in range(20)) + " rare" * (i % 100 == 0)) for i in range(n)], "id long, text string").cache()
    docs.count()
    before = shuffled(spark)
    inverted.build(docs, path)
    built = shuffled(spark)
    assert built - before < 1.1 * n * 21 + 1000  # 20 or 21 terms a document, and the document
    assert len(inverted.search(spark.createDataFrame([(1, "rare")], "query_id long, text string"), path, 10).collect()) == 6
    assert shuffled(spark) - built < 500


def test_counts_within_a_row(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), ([],), (["z"],)], "t array<string>")
    got = [[tuple(x) for x in r[0] or []] for r in rows.select(inverted._counted(F.col("t"))).collect()]
    assert got == [[("a", 2), ("b", 1), ("c", 3)], [], [("z", 1)]]
