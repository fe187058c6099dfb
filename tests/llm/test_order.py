"""Operator 3 with orders of three and more against a model counted by hand."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import lm

TRAIN = ["", None, "a", "b", "a b", "a b c", "a b d", "b a b c a b c d", "c a b d a b c", "d d d d d d d", "a a b a b b a c d c b a", "e a b c", "e a b d b", "c", "c d a b c a", "a b c d e f g a b c d e"]
SCORED = [*TRAIN, "x", "a x b c", "a b x c a b c", "f g a b", "g f e d c b a"]


def brute(train: list[list[str]], order: int):
    raw = {k: Counter(tuple(s[i : i + k]) for s in (["<s>", *t] for t in train) for i in range(len(s) - k + 1)) for k in range(1, order + 1)}
    counts = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in raw[k + 1])
        counts[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>" and k > 1})
    d = {k: lm.discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    own = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            own[k][g[:-1]].append(n)

    def p(context: tuple, word: str) -> float:
        k = len(context) + 1
        low = p(context[1:], word) if k > 1 else 1 / (len(counts[1]) + 1)
        found = own[k][context]
        if not found:
            return low
        n = counts[k][(*context, word)]
        return max(n - d[k][min(n, 3)], 0) / sum(found) + sum(d[k][min(x, 3)] for x in found) / sum(found) * low

    return p


@pytest.mark.parametrize(("order", "part_rows"), [(2, 7), (3, 7), (3, 40), (3, 1000), (4, 10), (4, 60)])
def test_orders_against_counting(spark, monkeypatch, order, part_rows):
    monkeypatch.setattr(lm, "PART_ROWS", part_rows)
    tokens = lambda t: [*(t or "").split(), "\n"]
    p, want = brute([tokens(t) for t in TRAIN], order), {}
    for i, t in enumerate(SCORED):
        s = ["<s>", *tokens(t)]
        want[i] = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
    model = lm.train(spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3), order=order)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(SCORED)), "doc_id int, text string"), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    vocabulary = ["a", "b", "c", "d", "e", "f", "g", "\n", "unknown"]
    assert np.isclose(sum(p(("a", "b")[3 - min(3, order) :], x) for x in vocabulary), 1)


def test_no_training_texts(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    model = lm.train(none, order=3)
    rows = lm.score(spark.createDataFrame([(1, "a b c")], "doc_id int, text string"), model).collect()
    assert [r.score for r in rows] == [0.0] and not lm.score(none, model).count()
    with pytest.raises(ValueError, match="two"):
        lm.train(none, order=1)


def test_tokens_against_splitting():
    rng = random.Random(1)
    marks = ["a", "B", "Z", "é", "中", "\x00", "\x1c", "\x85", " ", " ", " ", "\n", "\t", "\r", "\x0b", "\x0c"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 90))) for _ in range(1000)] + [None, "", " ", "abcdefgh", "abcdefghi", "abcdefgh i"]
    texts += ["x" * n + end for n in (31, 32, 33, 34, 500) for end in ("", " ", "é")]
    hashes, lengths = lm.tokens(texts)
    words = [w for t in texts for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]]
    assert [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) + 1 for t in texts] == lengths.tolist()
    assert len(words) == len(hashes)
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist(), strict=True)))
    assert len(lm.tokens([])[0]) == 0


def test_state_of_many_parts_stays_small(tmp_path, monkeypatch):
    import pickle

    monkeypatch.setattr(lm, "MOST_OPEN", 50)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    part = lm.part_of(h, 100_000)
    for p in np.unique(part)[:300]:
        lm.store_table(str(tmp_path), int(p), h[part == p], [np.arange(1, 1 + int((part == p).sum()), dtype=np.uint64)])
    table = lm.Table(str(tmp_path))
    stored = np.isin(part, np.unique(part)[:300])
    assert (table.find(h, part)[0] > 0).tolist() == stored.tolist()  # parts without a file hold nothing
    assert len(table._open) <= 50 and len(pickle.dumps(table)) < 1000
