"""Candidate keys of fuzzy_terms against a comparison of all pairs."""

import itertools

from lodestone.plans.texts import fuzzy_terms


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_kinds_of_one_edit(spark, tmp_path):
    names = ["car cars scar cat cut chat", "steel steels steely stee", "a  ab b", "aa aaa aaaa ba"]  # a double space makes an empty word
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    words = sorted({w for n in names for w in n.split(" ")})
    want = {(a, b) for a, b in itertools.combinations(words, 2) if distance(a, b) <= 1}
    got = [tuple(r) for r in fuzzy_terms(spark, str(tmp_path)).collect()]
    assert {("car", "cars"), ("steel", "steels"), ("", "a"), ("car", "scar")} <= want
    assert set(got) == want and len(got) == len(want)
