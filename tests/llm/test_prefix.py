"""Operator 10: what the prefix filter may lose at any threshold."""

from math import comb

import numpy as np
import pytest

from lodestone.llm import neardup


@pytest.mark.parametrize("percent", [3, 10, 30, 50, 70, 80, 85, 95, 99, 100])
def test_miss_chance_of_the_prefix(percent):
    t = percent / 100
    size, least = neardup.least_overlap(t)
    relied_on = size - neardup.prefix_length(10**6, t) + 1  # so many shared values at least reach into the prefix
    assert relied_on <= least and size >= neardup.SKETCH
    assert 1 <= least and sum(comb(size, k) * t**k * (1 - t) ** (size - k) for k in range(relied_on)) <= 2.5e-6 + 1e-12


def test_range():
    for t in (0.0, -0.5, 1.5):
        with pytest.raises(ValueError, match="percent"):
            neardup.least_overlap(t)


def test_contained_text_with_few_shared_values(spark):
    """A text in a longer near copy, Jaccard 0.8, whose tail has 26 of the copy's 64 smallest values."""
    hashes = neardup.hasher()
    words = [f"w{i}" for i in range(404)]
    short, limit, small = list(words), np.uint64(2**64 // 500 * 40), 0
    for i in range(100):
        for j in range(1000):
            low = hashes(" ".join([*words[-4:], f"t{i}x{j}"]), 5)[0] < limit
            if low == (small < 26):
                break
        small += low
        words.append(f"t{i}x{j}")
    a, b = hashes(" ".join(short), 5), hashes(" ".join(words), 5)
    shared = len(np.intersect1d(a[:64], b[:64]))
    assert len(np.intersect1d(a, b)) / len(b) == 0.8 and len(a) == 400 and 35 <= shared < 40
    rows = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(words))], "doc_id long, text string")
    assert {r.id: r.component_id for r in neardup.groups(rows, words=5, percent=80).collect()} == {1: 1, 2: 1}
    assert [r.doc_id for r in neardup.deduplicate(rows).collect()] == [1]
