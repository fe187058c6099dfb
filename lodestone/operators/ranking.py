"""Normalising and cutting ranked rows, for all queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Varying:
    """A setting that differs from run to run: the column that holds it, and its largest value."""

    column: str
    most: float


Setting = int | float | Varying


def setting(x: Setting) -> Column:
    return F.col(x.column) if isinstance(x, Varying) else F.lit(x)


def normalised(value: Column, by: list[str]) -> Column:
    """Min-max to [0, 1] within a partition; 1 where all values are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def with_normalised(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """normalised() for a few large groups: their least and largest values are aggregated and joined back, so no group meets in one task."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    spread = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return df.join(ends, by, "left").withColumn(out, F.when(high == low, F.lit(1.0)).otherwise((F.col(value) - low) / spread)).drop("_low", "_high")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def threshold_or_default(c: Column, default: float = 0.5) -> Column:
    """A threshold given with a row: cut to [0, 1], the default where none is given."""
    return clamp01(F.coalesce(c.cast("double"), F.lit(default)))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int | Varying, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, with their rank from 1. A varying n is cut at its largest value before the shuffle."""
    most = n.most if isinstance(n, Varying) else n
    if most < 1:
        raise ValueError("n must be 1 or more")
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col(rank) <= F.lit(int(most))) & (F.col(rank) <= setting(n)) if isinstance(n, Varying) else F.col(rank) <= n)


def checked_threshold(theta: Setting) -> Setting:
    if not isinstance(theta, Varying) and not 0 <= theta <= 1:
        raise ValueError("thresholds are in [0, 1]")
    return theta


def promote(objects: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only the columns have reached."""
    return columns.select(*keys).distinct().join(objects.select(*keys), keys, "left_anti")


#: What test mode keeps, databases and questions of each.
TEST_DATABASES, TEST_QUESTIONS = 2, 5


def capped(df: DataFrame, db: str, order: list[Column], databases: int | None = None, questions: int | None = None, test: bool = False) -> DataFrame:
    """The first `questions` rows of each of the first `databases` databases by name; None keeps all. Test mode fills in small caps.

    The chosen names are as many rows as the cap allows, so their join may be broadcast.
    """
    if test:
        databases, questions = TEST_DATABASES if databases is None else databases, TEST_QUESTIONS if questions is None else questions
    if min(x for x in (databases, questions, 0) if x is not None) < 0:
        raise ValueError("caps must not be negative")
    if databases is not None:
        df = df.join(df.select(db).distinct().orderBy(db).limit(databases), db, "left_semi")
    if questions == 0:
        return df.limit(0)
    return df if questions is None else top_n(df, [db], order, questions, "_nth").drop("_nth")
