"""Retrieval metrics of one ranked list against a set, as expressions over arrays; names compare without case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(names: Column) -> Column:
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.lower(x.cast("string")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def hits(expected: Column, found: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(expected), F.array_distinct(found)))


def precision_recall_f1(expected: Column, found: Column) -> tuple[Column, Column, Column]:
    """An empty side gives zeros."""
    n = hits(expected, found)
    p, r = ratio(n, F.size(F.array_distinct(found))), ratio(n, F.size(F.array_distinct(expected)))
    return p, r, f1_of(p, r)


def at(found: Column, k: int | Column) -> Column:
    return F.slice(found, 1, k)


def hit_at(expected: Column, found: Column, k: int | Column) -> Column:
    return hits(expected, at(found, k)) > 0


def recall_at(expected: Column, found: Column, k: int | Column) -> Column:
    """1 where nothing is expected."""
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(ratio(hits(expected, at(found, k)), F.size(F.array_distinct(expected))))


def reciprocal_rank(expected: Column, found: Column) -> Column:
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(places) == 0, F.lit(0.0)).otherwise(1.0 / F.coalesce(F.array_min(places), F.lit(1)))


def jaccard(expected: Column, found: Column) -> Column:
    """1 where both are empty."""
    union = F.size(F.array_union(expected, found))
    return F.when(union == 0, F.lit(1.0)).otherwise(ratio(hits(expected, found), union))


def exact_match(expected: Column, found: Column) -> Column:
    return F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(found))


def top_n_accuracy(expected: Column, found: Column) -> Column:
    """Share of the first len(expected) slots that are expected."""
    n = F.size(F.array_distinct(expected))
    return ratio(hits(expected, at(found, n)), n)
