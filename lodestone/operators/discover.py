"""Three strategies that roll fine-grained hits (columns) up into ranked objects, for all queries in one job.

Hits carry query_id, the object's key and a total order. Scores are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import Setting, Varying, checked_threshold, clamp01, normalised, setting, top_n

#: What tells rankings apart; runs with settings of their own add a column.
BY = ("query_id",)


def _support(columns: DataFrame, obj: str, score: str, n: Setting, by: list[str]) -> DataFrame:
    """Mean of the n best columns of each object, and those columns in order."""
    best = top_n(columns, [*by, obj], [F.desc(score), F.asc("rank"), F.asc("id")], n, "_nth")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "id"))), lambda x: x["id"])
    return best.groupBy(*by, obj).agg(F.avg(score).alias("support"), listed.alias("columns"))


def _ranked(scored: DataFrame, tie: list, k: Setting, by: list[str]) -> DataFrame:
    return top_n(scored, by, [F.desc("score"), *tie], k, "rank")


def _mixed(alpha: Setting, a, b):
    """alpha of the first and the rest of the second score, in [0, 1]."""
    return F.round(clamp01(setting(alpha) * a + (1 - setting(alpha)) * F.coalesce(b, F.lit(0.0))), 6).alias("score")


def sequential(
    objects: DataFrame, columns: DataFrame, obj: str, k: Setting = 10, k0: Setting = 50, n: Setting | None = None, cols_per_obj: Setting = 3, alpha: Setting = 0.65, threshold: Setting = 0.5, by=BY
) -> DataFrame:
    """Objects first, then only their columns. objects: query_id, obj, score; columns: query_id, id, obj, score."""
    by, theta = list(by), checked_threshold(threshold)
    n = n or 5 * k0
    first = top_n(objects, by, [F.desc("score"), F.asc(obj)], k0, "_orank").where(F.col("score") >= setting(theta))
    inside = columns.join(first.select(*by, obj), [*by, obj], "left_semi")
    near = top_n(inside, by, [F.desc("score"), F.asc("id")], n, "rank").where(F.col("score") >= setting(theta))
    joined = first.join(_support(near, obj, "score", cols_per_obj, by), [*by, obj], "left")
    scored = joined.select(*by, obj, _mixed(alpha, F.col("score"), F.col("support")), "_orank", "columns")
    return _ranked(scored, [F.asc("_orank")], k, by).drop("_orank")


def parallel(objects: DataFrame, columns: DataFrame, obj: str, k: Setting = 10, m: Setting | None = None, cols_per_obj: Setting = 3, alpha: Setting = 0.60, by=BY) -> DataFrame:
    """Objects and columns apart; objects that only columns reach are promoted with the lowest object score."""
    by = list(by)
    if not isinstance(m, Varying):
        m = max(k + 1, m or 5 * k)
    first = top_n(objects, by, [F.desc("score"), F.asc(obj)], k, "_orank")
    near = top_n(columns, by, [F.desc("score"), F.asc("id")], m, "rank")
    # Normalising comes before promotion: promoted objects stand at 0, or at 1 where all objects do.
    normal = first.withColumn("_norm", normalised(F.col("score"), by))
    level = first.groupBy(*by).agg(F.when(F.max("score") == F.min("score"), 1.0).otherwise(0.0).alias("_level"))
    only = near.groupBy(*by, obj).agg(F.min("rank").alias("_orank")).join(first.select(*by, obj), [*by, obj], "left_anti").join(level, by, "left")
    promoted = only.select(*by, obj, F.coalesce("_level", F.lit(1.0)).alias("_norm"), (F.col("_orank") + F.lit(1_000_000)).alias("_orank"))
    everything = normal.select(*by, obj, "_norm", "_orank").union(promoted)
    columns_normal = near.withColumn("_cnorm", normalised(F.col("score"), by))
    joined = everything.join(_support(columns_normal, obj, "_cnorm", cols_per_obj, by), [*by, obj], "left")
    scored = joined.select(*by, obj, _mixed(alpha, F.col("_norm"), F.col("support")), "_orank", "columns")
    return _ranked(scored, [F.asc("_orank")], k, by).drop("_orank")


def unified(hits: DataFrame, obj: str, k: Setting, m: Setting = 10, cols_per_obj: Setting = 10, threshold: Setting = 0.5, by=BY) -> DataFrame:
    """One search over columns that carry their object; hits: query_id, id, obj, score."""
    by, theta = list(by), checked_threshold(threshold)
    near = top_n(hits, by, [F.desc("score"), F.asc("id")], m, "rank").withColumn("_norm", normalised(F.col("score"), by))
    rolled = _support(near.where(F.col("_norm") >= setting(theta)), obj, "_norm", cols_per_obj, by)
    return _ranked(rolled.select(*by, obj, F.round("support", 6).alias("score"), "columns"), [F.asc(obj)], k, by)
