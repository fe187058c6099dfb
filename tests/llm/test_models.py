"""Operators 3, 6, 9 and 10 below Spark: conditional random fields, smoothing, sketches, curves."""

import itertools

import numpy as np
import pytest

from lodestone.llm import crf, hilbert, langid, lm, neardup, quality


def test_crf_against_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(15):
        monkeypatch.setattr(crf, "BLOCK", int(rng.integers(1, 5)))
        k, lengths = rng.integers(1, 4), rng.integers(1, 7, 5)
        scores, trans, start = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
        got, best = crf.marginals(scores, lengths, trans, start), crf.viterbi(scores, lengths, trans, start)
        p, pairs, _ = crf._expected(scores, lengths, trans, start)
        at, all_pairs = 0, np.zeros((k, k))
        for n in lengths:
            total, want, top, seen = 0.0, np.zeros((n, k)), (-1e9, None), np.zeros((k, k))
            for y in itertools.product(range(k), repeat=int(n)):
                s = start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
                w = np.exp(s)
                total += w
                for i in range(n):
                    want[i, y[i]] += w
                for i in range(n - 1):
                    seen[y[i], y[i + 1]] += w
                top = max(top, (s, y), key=lambda x: x[0])
            assert np.allclose(got[at : at + n], want / total) and np.allclose(p[at : at + n], want / total)
            assert tuple(best[at : at + n]) == top[1]
            all_pairs += seen / total
            at += n
        assert np.allclose(pairs, all_pairs)


def test_switches_are_found():
    rng = np.random.default_rng(1)
    words = {"aa": [f"ka{c}o" for c in "bcdfg"], "bb": [f"{c}enth" for c in "bcdfg"]}
    windows = [(lang, [str(w) for w in rng.choice(own, 20)]) for lang, own in words.items() for _ in range(30)]
    model = langid.fit(windows)
    text = ["kabo", "kaco", "kado", "benth", "centh", "denth", "kaxo"]
    scores = langid.word_scores([langid.letters_of(w) for w in text], model.lexicon, model.crf.weights.astype(float))
    p = crf.marginals(scores, np.array([len(text)]), model.crf.trans, model.crf.start)
    assert p.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 0]
    assert langid.letters_of("(Ab-c)!") == "ab-c" and langid.letters_of("12") == ""
    assert langid.fit([]).crf.labels == []


def test_discounts():
    d = lm.discounts([100, 40, 20, 10])
    y = 100 / 180
    assert np.allclose(d, [0, 1 - 2 * y * 40 / 100, 2 - 3 * y * 20 / 40, 3 - 4 * y * 10 / 20])
    assert (lm.discounts([0, 0, 0, 0]) == [0, 0.5, 0.5, 0.5]).all()
    x = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(lm.mixed(x))) == 1000 and set(lm.part_of(lm.mixed(x), 3).tolist()) == {0, 1, 2}


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    table, place = hilbert.curve_table(dims), {}
    for p in itertools.product(range(1 << bits), repeat=dims):
        state = index = 0
        for level in reversed(range(bits)):
            found = table[state << dims | sum(((x >> level) & 1) << k for k, x in enumerate(p))]
            state, index = found >> dims, index << dims | found & ((1 << dims) - 1)
        place[index] = p
    assert sorted(place) == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(len(place) - 1))


def test_sketch_estimate_is_the_unions_sketch():
    rng = np.random.default_rng(3)
    for _ in range(500):
        base = rng.choice(2**62, rng.integers(2, 300), replace=False).astype(np.uint64)
        a, b = (np.unique(np.append(base[rng.random(len(base)) < 0.9], base[0])) for _ in range(2))
        got, k = neardup.estimate(a[:64], b[:64], len(a), len(b))
        union, both = np.union1d(a, b), np.intersect1d(a, b)
        want = np.isin(union[:k], both).mean() if k else len(both) / len(union)
        assert abs(got - want) < 1e-12


def test_prefix_lengths():
    assert [neardup.prefix_length(n, 0.85) for n in (1, 7, 20)] == [1, 2, 4]
    assert all(25 <= neardup.prefix_length(n, 0.85) <= 64 for n in (64, 80, 10**6))


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 3, rng.integers(0, 40))
        windows = [tuple(ids[i : i + 5]) for i in range(len(ids) - 4)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        assert quality.repeated_words(ids) == len(covered)


def test_line_labels():
    good = [(1, "Some plain words stand here.\nAnother line of such words.") for _ in range(30)]
    bad = [(0, "A## b$$ c%%\n| x | y | z |") for _ in range(30)]
    model = quality.fit(good + bad)
    ids = quality.bins(np.array([quality.line_statistics(x, x.split(), False) for x in ("More plain words here.", "Q## r$$ s%%")]))
    assert crf.viterbi(model.weights[ids].sum(axis=1), np.array([1, 1]), model.trans, model.start).tolist() == [0, 1]
    assert quality.fit(good) is None and quality.fit([]) is None
