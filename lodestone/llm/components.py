"""Connected components of a table of links, without collecting links or components anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014): each links the neighbours of a node to the smallest
one, until every component is a star around its smallest node. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _to_smallest(links: DataFrame, own: bool) -> DataFrame:
    """Each (u, v) becomes (v, smallest of u and its neighbours); with own, u is linked to the smallest too."""
    least = links.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    moved = links.join(least, "u")
    if own:
        return moved.select(F.col("v").alias("a"), F.col("_m").alias("b")).union(least.select("u", "_m")).where("a <> b").distinct()
    return moved.where("v > u").select(F.col("v").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """Staged: (node, component) for every node of links (a, b), both long and not null; component is the smallest node reachable."""
    now = common.staged(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct(), "links")
    before = _mark(now)
    for _ in range(most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_smallest(both, False)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = common.staged(_to_smallest(down, True), "links", done=(now,))
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return common.staged(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components", done=(now,))
