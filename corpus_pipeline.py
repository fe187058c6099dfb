"""A training-data pipeline over `documents`: language ID, quality rules, near-duplicate removal and packing.

Each stage works on all rows that the stage before it kept; stages hand over Parquet tables. All but the last return the
columns of documents. Rows with nulls, empty texts, repeated rows and empty tables pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, langid, neardup, packing, quality

#: A text whose words have a smaller posterior in the mean, each in its own best language, is in no language in particular.
LEAST_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or words that are in no language clearly. Texts that switch between languages stay."""
    model = langid.fit_table(docs)
    if not model.crf.labels:
        return docs  # nothing is labelled: nothing can be said against a document
    pred, score, sure = (common.free(c, docs.columns) for c in ("_language", "_language_score", "_language_sure"))
    found = langid.predict(docs, model, pred=pred, score=score, sure=sure)
    good = (F.col(pred) != langid.UNKNOWN) & (F.col(sure) >= LEAST_LANGUAGE_SCORE)
    return found.where(good).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base counts or are mostly boilerplate lines."""
    model = quality.fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = {c: common.free(f"_own_{c}", docs.columns) for c in docs.columns if c in quality.RESULT_NAMES}
    judged = quality.judge(docs.withColumnsRenamed(clash), model).where("kept")
    return judged.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return neardup.deduplicate(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences."""
    return packing.pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The learned labellings are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
