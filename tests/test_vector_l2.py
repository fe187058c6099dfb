"""Distances of vectors with large norms in blocks of any size."""

import numpy as np

from lodestone.operators import search


def test_equal_rows_have_distance_zero(spark):
    x = np.random.default_rng(6).normal(size=(900, 64)) * 12.5  # norms of about 100
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = spark.createDataFrame(rows, "query_id long, vector array<double>")
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    found = search.vector_search(queries, corpus, 1, "l2", skip_self=False).collect()
    assert {(r.query_id, r.id, r.score) for r in found} == {(i, i, 0.0) for i in range(900)}
