"""Operator 10 and the pipeline's stages over rows that share ids, tied rows and clashing column names."""

import random

import corpus_pipeline
from lodestone.llm import neardup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def shingles(text, n):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """Components of ids: linked by similar texts, whichever of their texts these are."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def text_of(rng, k, size=40):
    own = random.Random(k)
    words = [f"{own.choice(WORDS)}{own.randint(0, 99)}" for _ in range(size)]
    if rng.random() < 0.5:
        words[rng.randrange(size)] = "changed"
    return " ".join(words)


def test_an_id_with_several_texts_is_one_document(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(60), text_of(rng, rng.randrange(25))) for _ in range(150)] + [(7, ""), (8, None), (None, text_of(rng, 3)), (3, text_of(rng, 1)), (5, text_of(rng, 1)), (5, text_of(rng, 2)), (61, text_of(rng, 2))]
    want = brute(rows, 3, 85)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == (want[r["id"]] if r["id"] is not None else None) for r in got)


def test_ties_keep_the_same_row(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same, c, "own") for c in "zxy"] + [(2, same, "w", "own"), (None, same, "n", "own")]
    kept = set()
    for k in range(3):
        order = rows[k:] + rows[:k]
        df = spark.createDataFrame(order, "doc_id long, text string, other string, _lodestone_id string").repartition(k + 1)
        kept.add(tuple(sorted((tuple(r) for r in neardup.deduplicate(df).collect()), key=repr)))
    assert kept == {((1, same, "x", "own"), (None, same, "n", "own"))}


def test_stages_keep_clashing_columns(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    names = ["kept", "_own_kept", "n_words", "_language", "_language_sure", "_lodestone_id", "_rows", "_least"]
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
