"""A block of vector search: its memory does not follow queries times targets, and ties go to the smaller id."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.operators import search


def test_scores_of_a_block_are_held_for_a_few_queries_only():
    rng = np.random.default_rng(8)
    n_query, n_target = search.QUERY_BLOCK, search.CORPUS_BLOCK
    x = rng.integers(-2, 3, (n_query + n_target, 4)).astype(float)  # many equal scores
    ids = np.concatenate([np.arange(n_query), rng.permutation(n_target)])
    table = pa.table({"asks": np.arange(len(x)) < n_query, "id": ids, "vector": pa.array(x.tolist())})
    tracemalloc.start()
    got = search.best_rows(10, "dot")(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    target = x[n_query:][np.argsort(ids[n_query:])]
    best = {q: got.filter(pa.array(np.asarray(got["query_id"]) == q))["id"].to_pylist() for q in (0, 63, 64, 1023)}
    for q, found in best.items():
        assert found == [i for i in np.argsort(-(target @ x[q]), kind="stable") if i != q][:10]
