"""Operator 8: categories that differ behind a long common start."""

from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import hilbert


def test_long_common_start(spark):
    names = [None, *(f"https://host/{k}" for k in range(7))]
    rows = [(i, names[i * 5 % 8]) for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    found = hilbert.shard_table(df, {"source": hilbert.string_number(F.col("source"))}, ["doc_id"], ["doc_id", "source"]).collect()
    own = defaultdict(set)
    for r in found:
        own[r.shard].add(r.source)
    assert len(found) == 320 and [own[k] for k in range(8)] == [{n} for n in names]
