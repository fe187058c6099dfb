"""The pipeline's first stage on texts that switch between languages."""

import numpy as np

import corpus_pipeline
from lodestone.llm import langid


def test_switching_texts_stay(spark):
    rng = np.random.default_rng(4)
    own = {"aa": [f"ka{c}o" for c in "bcdfg"], "bb": [f"{c}enth" for c in "bcdfg"], "cc": [f"{c}uzziq" for c in "bcdfg"], "dd": [f"myl{c}y" for c in "bcdfg"]}
    some = lambda lang, n: [str(w) for w in rng.choice(own[lang], n)]
    rows = [(100 * k + i, " ".join(some(lang, 20)), lang) for k, lang in enumerate(own) for i in range(30)]
    rows += [(1000, " ".join(w for lang in own for w in some(lang, 12)), None), (1001, "12 34 !!", None), (1002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_table(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model, sure="sure").collect()}
    assert found[1000].score < corpus_pipeline.LEAST_LANGUAGE_SCORE < 0.8 < found[1000].sure <= 1
    assert all(r.score <= r.sure + 1e-9 for r in found.values()) and found[1001].sure == found[1002].sure == 0
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {1001, 1002}
