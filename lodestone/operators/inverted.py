"""A stored keyword index: postings in blocks with their largest possible impact, read block by block as a query needs them.

A segment has two tables. `docs` has each document's terms, length and window (WINDOW documents that are neighbours by id). `postings` has one row,
a block, for each term and window: ids, counts and lengths, and the block's largest count and smallest length, which bound what any of its
documents can score, whatever the collection's average length has become. Blocks lie in folders by term (BUCKETS of them) and in order within.

A search first reads the blocks' bounds only. A window's bound for a query is the sum of its blocks' bounds. The windows with the largest bounds
are scored; the score of the last wanted place is then a floor, and of the other windows only those whose bound reaches it are
read. What is skipped cannot be among the best, so results are those of scoring everything. No text is read.

Refreshed and deleted ids are marked (see versions); collection statistics are corrected by what the marked documents held.
Rows with a null id are left out; of rows with one id in one write, the one with the greatest text counts; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import versions
from lodestone.operators.frozen import frozen
from lodestone.operators.ranking import top_n
from lodestone.operators.search import few_terms, query_terms
from lodestone.shipping import ship

WINDOW, BUCKETS = 512, 64
#: Windows of a query that are scored first, to find the floor.
FIRST_WINDOWS = 4
#: Scores are rounded to six digits, so a bound that is smaller by this may still tie.
SLACK = 1e-6
DOCS = "id long, len long, window long, terms array<string>"
BLOCKS = "term string, window long, n long, max_tf long, min_len long, ids array<long>, tfs array<long>, lens array<long>"
POSTINGS = f"{BLOCKS}, bucket int"


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _write_segment(docs: DataFrame, path: str) -> None:
    rows = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id IS NOT NULL")
    # Texts are shuffled once: ranges of ids keep rows of one id together, so the grouping needs no shuffle of its own.
    rows = rows.repartitionByRange("id").groupBy("id").agg(F.max("text").alias("text"))
    _write_terms(rows.select("id", T.index_terms(F.col("text")).alias("terms")), path)


def _write_terms(terms: DataFrame, path: str) -> None:
    """A segment of (id, terms), which has an id once; neighbours within a partition share a window."""
    # Ids count up within a partition from a start of its own, so cutting the low bits gives neighbours one window; written once, read below.
    window = F.expr(f"monotonically_increasing_id() div {WINDOW}")
    rows = terms.sortWithinPartitions("id").select("id", F.size("terms").cast("long").alias("len"), window.alias("window"), "terms")
    rows.write.parquet(f"{path}/docs")
    stored = terms.sparkSession.read.schema(DOCS).parquet(f"{path}/docs")
    # Blocks are made where their window is read and shuffled once, without ranges that would ask for a sample and so for making them twice.
    # A folder has as many files as its size asks for, and files are in order by term, so a search passes over pages of other terms.
    blocks = _blocks(stored).withColumn("bucket", _bucket()).hint("rebalance", "bucket")
    blocks.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{path}/postings")


def _blocks(stored: DataFrame) -> DataFrame:
    """The blocks of stored documents. Rows of a window follow each other in a file; of a file that is read in parts, a window may have two blocks for
    a term, which add up to the same scores and to a larger bound."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            windows = b.column("window").to_numpy()
            for start, end in pairwise([0, *(np.flatnonzero(np.diff(windows)) + 1).tolist(), len(windows)] if len(windows) else []):
                if held and windows[start] != last:
                    yield _window_blocks(pa.Table.from_batches(held))
                    held = []
                last = windows[start]
                held.append(b.slice(start, end - start))
        if held:
            yield _window_blocks(pa.Table.from_batches(held))

    return stored.select("id", "len", "window", "terms").mapInArrow(run, BLOCKS)


def _window_blocks(rows: pa.Table) -> pa.RecordBatch:
    """One window's blocks, one for each term in order: documents in their order, how often they have it, and their lengths."""
    lists, n = rows.column("terms").combine_chunks(), rows.num_rows
    words = lists.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy().astype(np.int64)  # what comes in runs is sorted sooner behind the shuffle
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    pairs, tfs = np.unique(place[words.indices.to_numpy()] * n + of, return_counts=True)
    term, row = np.divmod(pairs, n)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts, len(term))
    lens = rows.column("len").to_numpy()[row]
    listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
    columns = [
        words.dictionary.take(pa.array(order[term[starts]])), pa.array(np.full(len(starts), rows.column("window")[0].as_py()), pa.int64()), pa.array(np.diff(ends), pa.int64()),
        pa.array(np.maximum.reduceat(tfs, starts), pa.int64()), pa.array(np.minimum.reduceat(lens, starts), pa.int64()), listed(rows.column("id").to_numpy()[row]), listed(tfs), listed(lens),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "window", "n", "max_tf", "min_len", "ids", "tfs", "lens"])


def _counted(terms: Column) -> Column:
    """(term, tf) of the different terms of a sorted array, within the row: each ends where the next one begins. The array is made once for each row."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return T.let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - at).cast("long").alias("tf"))))

    return T.let(terms, runs)


def _totals(docs: DataFrame) -> dict:
    r = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
    return {"docs": r["docs"], "length": r["length"]}


def build(docs: DataFrame, path: str) -> None:
    """Index (id, text) as version 1 of a new index."""
    if versions.latest(docs.sparkSession, path).version:
        raise ValueError(f"there is an index at {path}")
    refresh(docs, path)


def refresh(docs: DataFrame, path: str) -> None:
    """Add (id, text); rows of ids that the index has already take the place of the old ones."""
    spark, name = docs.sparkSession, versions.fresh("segment")
    now = versions.latest(spark, path)
    _write_segment(docs, f"{path}/{name}")
    own = spark.read.schema(DOCS).parquet(f"{path}/{name}/docs")
    marker, less = _mark(own.select("id"), path, now)
    more = _totals(own)
    versions.publish(spark, path, now.after(name, marker, **{k: more[k] - less.get(k, 0) for k in more}))


def delete(ids: DataFrame, path: str) -> None:
    """Remove the ids of a table (id); ids that the index lacks change nothing."""
    now = versions.latest(ids.sparkSession, path)
    marker, less = _mark(ids.select(F.col("id").cast("long").alias("id")), path, now)
    versions.publish(ids.sparkSession, path, now.after(None, marker, **{k: -v for k, v in less.items()}))


def _mark(ids: DataFrame, path: str, now: versions.Manifest) -> tuple[str | None, dict]:
    """Write the marker for what the index has of these ids, and by how much it lowers each term's document count."""
    if not now.segments:
        return None, {}
    spark, name = ids.sparkSession, versions.fresh("marker")
    old = versions.live(versions.segment_rows(spark, path, now, "docs", DOCS), path, now, wide=True).join(versions.sent(ids.distinct()), "id", "left_semi")
    old.select("id", "len", "terms").write.parquet(f"{path}/{name}/ids")
    gone = spark.read.schema("id long, len long, terms array<string>").parquet(f"{path}/{name}/ids")
    gone.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{path}/{name}/less")
    return name, _totals(gone)


def compact(spark: SparkSession, path: str) -> None:
    """Write the live documents as one segment without markers; results stay the same. Old segments stay for readers until versions.clean().

    Stored terms are taken as they are. Documents stay where they are read, beside the neighbours that they have; where that would
    need a shuffle, they are dealt out by ranges of ids instead.
    """
    now, name = versions.latest(spark, path), versions.fresh("segment")
    rows = versions.live(versions.segment_rows(spark, path, now, "docs", DOCS), path, now, wide=True).select("id", "terms")
    few = not now.markers or versions.is_few(versions.marks(spark, path, now))
    _write_terms(rows if few else rows.repartitionByRange("id"), f"{path}/{name}")
    versions.publish(spark, path, versions.Manifest(now.version + 1, (name,), (), now.totals))


@dataclass(frozen=True)
class Search:
    """The parts of one search: bounds of (query_id, seg, window) with their number of blocks, the windows scored first, the rest that was read, and the hits."""

    bounds: DataFrame
    first: DataFrame
    rest: DataFrame
    hits: DataFrame

    def report(self) -> DataFrame:
        """One row: blocks of the asked terms, and how many of them were read."""
        count = lambda df, name: df.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias(name))
        parts = [count(self.bounds, "blocks"), count(self.first, "read_first"), count(self.rest, "read_after")]
        return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def searched(queries: DataFrame, path: str, top: int, scorer: str = "bm25", k1: float = 1.2, b: float = 0.75) -> Search:
    """The best `top` documents of each query (query_id, text) by BM25, or by the number of asked terms that they have (overlap).

    The version that is the last one now is searched, whatever is published meanwhile.
    """
    if scorer not in ("bm25", "overlap"):
        raise ValueError("scorer is bm25 or overlap")
    spark = queries.sparkSession
    now = versions.latest(spark, path)
    n_docs, length = now.totals.get("docs", 0), now.totals.get("length", 0)
    average = max(length, 1) / max(n_docs, 1)
    asked = query_terms(queries, F.col("text")).withColumn("bucket", _bucket())
    postings = versions.segment_rows(spark, path, now, "postings", POSTINGS)
    few = few_terms(asked)
    if few is not None:  # so that only blocks of asked terms are shuffled
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        postings = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(few))
    terms = asked.select("bucket", "term").distinct()
    # Kept, as bounds and the terms' numbers of documents come from it, and these are asked for with each lot of windows.
    heads = frozen(postings.select("bucket", "term", "seg", "window", "n", "max_tf", "min_len").join(terms, ["bucket", "term"]))
    freq = heads.groupBy("term").agg(F.sum("n").alias("df"))
    for name, _ in now.markers:
        less = spark.read.schema("term string, n long").parquet(f"{path}/{name}/less").withColumnRenamed("n", "_less")
        freq = freq.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("_less", F.lit(0))).alias("df"))
    # A term's number of documents is on each of its queries' rows.
    weighed = asked.join(freq, "term").withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def impact(tf: str, size: str) -> Column:
        if scorer == "overlap":
            return F.lit(1.0)
        return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(size) / average))

    bounds = heads.join(weighed.select("query_id", "term", "idf"), "term").groupBy("query_id", "seg", "window").agg(F.sum(impact("max_tf", "min_len")).alias("bound"), F.count("*").alias("blocks"))
    bounds = frozen(bounds)

    def scores(windows: DataFrame) -> DataFrame:
        wanted = windows.select("query_id", "seg", "window").join(weighed, "query_id")
        rows = postings.join(wanted, ["bucket", "term", "seg", "window"]).select("query_id", "seg", "idf", F.inline(F.arrays_zip("ids", "tfs", "lens")))
        rows = versions.live(rows, path, now, "ids")
        total = F.sum(impact("tfs", "lens"))
        return rows.groupBy("query_id", F.col("ids").alias("id")).agg((F.round(total, 6) if scorer == "bm25" else total).alias("score"))

    order = [F.desc("score"), F.asc("id")]
    first = top_n(bounds, ["query_id"], [F.desc("bound"), F.asc("seg"), F.asc("window")], FIRST_WINDOWS, "_nth").drop("_nth")
    found = frozen(top_n(scores(first), ["query_id"], order, top))
    floor = found.where(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(first, ["query_id", "seg", "window"], "left_anti").join(floor, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
    hits = top_n(found.drop("rank").union(scores(rest)), ["query_id"], order, top)
    return Search(bounds, first, rest, hits)


def search(queries: DataFrame, path: str, top: int, scorer: str = "bm25", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): see searched()."""
    return searched(queries, path, top, scorer, k1, b).hits.select("query_id", "id", "score", "rank")
