"""Stems against published examples, substring look-up, recursive chunks, JSON tables."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search, wordlist
from lodestone.sources import readers

#: Words and their stems as published with the English stemmer's rules.
STEMS = """
caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size,
hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc,
hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal,
decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr,
electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit,
replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect,
bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, generalizations gener, oscillators oscil, at at, is is, x2 x2, übung übung, Running Running
"""


def test_published_stems(spark):
    pairs = [p.split() for p in STEMS.split(",")]
    got = {r.term: r.stem for r in wordlist.stemmed(spark.createDataFrame([(a,) for a, _ in pairs], "term string")).collect()}
    assert got == dict(pairs)


def test_stems_leave_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "cats"), (2, None), (3, "")], "n int, term string")
    assert sorted(map(tuple, wordlist.stemmed(df, out="s").collect())) == [(1, "cats", "cat"), (2, None, None), (3, "", "")]


def test_terms_by_a_part(spark):
    rng = random.Random(3)
    terms = {"".join(rng.choices("abcä", k=rng.randint(1, 9))) for _ in range(300)} | {"a", "abc"}
    patterns = ["a", "ab", "abc", "cab", "äbca", "zzz", "", None, "aaaaaaaaaaaa", "a%b"]
    df = spark.createDataFrame([(t,) for t in [*terms, "abc", "", None]], "term string")
    got = wordlist.containing(spark.createDataFrame([(p,) for p in [*patterns, "ab"]], "pattern string"), wordlist.gram_postings(df))
    assert sorted(map(tuple, got.collect())) == sorted((p, t) for p in patterns if p for t in terms if p in t)


def test_only_terms_under_the_rarest_gram_are_looked_at(spark):
    df = spark.createDataFrame([(f"common{i}",) for i in range(500)] + [("commonxyz",)], "term string")
    postings = wordlist.gram_postings(df)
    got = wordlist.containing(spark.createDataFrame([("commonxyz",)], "pattern string"), postings)
    assert [r.term for r in got.collect()] == ["commonxyz"]
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_recursive_chunks(spark):
    words = lambda n, w="w": " ".join([w] * n)
    text = f"short one.\n\n{words(6)}. {words(3, 'x')}! {words(23, 'y')}\n  \nend"
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.recursive_chunks(F.col("t"), 10, 2).alias("c")).collect()
    assert [len(c) for c in row[0].c] == [2, 6, 3, 10, 10, 7, 1] and row[0].c[1] == ["w"] * 5 + ["w."] and row[1].c == row[2].c == []


def test_chunk_search(spark):
    docs = spark.createDataFrame([(1, "red house\nblue car\nred red"), (2, "green tree"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red"), (8, "nothing")], "query_id long, text string")
    best = search.chunk_search(asked, docs).collect()
    assert [(r.query_id, r.id, r.n_chunks, [c.chunk for c in r.chunks]) for r in best] == [(7, 1, 2, [2, 0])] and best[0].score == best[0].chunks[0].score
    mean = search.chunk_search(asked, docs, aggregator="AVG", best=1).first()
    assert abs(mean.score - sum(c.score for c in best[0].chunks) / 2) < 1e-6 and len(mean.chunks) == 1


def test_json_tables(spark):
    docs = [
        {"id": 1, "meta": {"n": 5}, "rows": [{"name": "a", "in": {"tags": ["x", "y"]}}, {"name": "b", "in": {"tags": []}}, {"name": None}]},
        {"id": 2, "rows": []},
        {"id": 3},
    ]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(9, "no json"), (10, None)], "k int, doc string")
    tags = readers.Nested("in.tags", {"tag": ("", "string")}, "tag_nr")
    got = readers.json_table(df, "doc", {"id": ("id", "int"), "n": ("meta.n", "int")}, readers.Nested("rows", {"name": ("name", "string")}, "row_nr", tags))
    assert got.columns == ["k", "id", "n", "row_nr", "name", "tag_nr", "tag"]
    none = (None,) * 4
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(0, 1, 5, 1, "a", 1, "x"), (0, 1, 5, 1, "a", 2, "y"), (0, 1, 5, 2, "b", None, None), (0, 1, 5, 3, None, None, None), (1, 2, None, *none), (2, 3, None, *none), (9, None, None, *none), (10, None, None, *none)],
        key=repr,
    )
    assert got.count() == 8 and readers.json_table(df, "doc", {"id": ("id", "int")}).count() == 5
