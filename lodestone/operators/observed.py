"""Runs database by database, as a harness does them: each sets up its index, searches, and is taken down, and the times of both are kept."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.operators import inverted, versions
from lodestone.operators.frozen import frozen

#: Databases of a run: the driver goes through them one by one.
MOST_DATABASES = 1000
TIMES = "db_id string, documents long, questions long, hits long, setup_ms double, search_ms double, avg_execution_time_ms double"


def run_by_database(docs: DataFrame, questions: DataFrame, path: str, top: int = 10, scorer: str = "bm25") -> tuple[DataFrame, DataFrame]:
    """Hits (db_id, query_id, id, score, rank) and one row of TIMES for each database of the questions.

    docs: db_id, id, text; questions: db_id, query_id, text. Documents are dealt once into a folder for each database, so their table is not gone
    through again for each; setup times share what that took by documents. Each database has an index of its own under the path, in which all its questions are
    searched in one job; questions and hits are observed as the rows go by, without counting them again. A database without documents has
    no hits. Rows without a database are left out.
    """
    spark = docs.sparkSession
    questions = frozen(questions.select("db_id", "query_id", "text"))
    names = [r["db_id"] for r in questions.select("db_id").where("db_id IS NOT NULL").distinct().limit(MOST_DATABASES + 1).collect()]
    if len(names) > MOST_DATABASES:
        raise ValueError(f"a run goes through {MOST_DATABASES} databases at most")
    names.sort()
    begun, folder = time.perf_counter(), f"{path}/{versions.fresh('documents')}"
    places = spark.createDataFrame(list(enumerate(names)), "place int, db_id string")  # a name need not do for a folder
    dealt = docs.join(F.broadcast(places), "db_id").select("id", "text", "place")
    dealt.write.partitionBy("place").parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    dealing = (time.perf_counter() - begun) * 1000
    found, times = [], []
    for place, name in enumerate(names):
        of_hits, of_questions = Observation(), Observation()
        own = f"{path}/{versions.fresh('database')}"
        begun = time.perf_counter()
        inverted.build(dealt.where(F.col("place") == place).select("id", "text"), own)
        documents = versions.latest(spark, own).totals["docs"]
        setup = (time.perf_counter() - begun) * 1000
        begun = time.perf_counter()
        asked = frozen(questions.where(F.col("db_id") == name).select("query_id", "text").observe(of_questions, F.count("*").alias("n")))
        hits = inverted.search(asked, own, top, scorer).select(F.lit(name).alias("db_id"), "query_id", "id", "score", "rank")
        found.append(frozen(hits.observe(of_hits, F.count("*").alias("n"))))
        took = (time.perf_counter() - begun) * 1000
        versions.drop(spark, own)
        n = of_questions.get["n"]
        times.append((name, documents, n, of_hits.get["n"], setup, took, took / max(n, 1)))
    versions.drop(spark, folder)
    total = max(sum(t[1] for t in times), 1)
    times = [(name, documents, n, hits, setup + dealing * documents / total, *rest) for name, documents, n, hits, setup, *rest in times]
    none = spark.createDataFrame([], "db_id string, query_id long, id long, score double, rank int")
    return reduce(lambda a, b: a.unionByName(b), found, none), spark.createDataFrame(times, TIMES)


def setup_time(times: DataFrame) -> DataFrame:
    """One row: databases, setup time over all of them, and the mean time of a question, weighted by questions."""
    mean = F.sum("search_ms") / F.nullif(F.sum("questions"), F.lit(0))
    return times.agg(F.count("*").alias("databases"), F.coalesce(F.sum("setup_ms"), F.lit(0.0)).alias("setup_ms"), mean.alias("avg_execution_time_ms"))
