"""Approximate vector search: an index of cells whose rows have short codes; the best by code are scored exactly.

* **Cells** follow the number of rows (about its square root): k-means centres in groups, which are cells of k-means themselves. Groups are fitted
  on a bounded sample; the cells of a group on rows of that group, in a task for each group. Every row is indexed.
* **Codes**: what is left of a row beside its cell's centre, cut into pieces of PIECE numbers, each named by the nearest of 256 fitted pieces.
* **Search**: cells are ranked by the exact distance of their centres, and taken until they hold the share `scan` of all rows. Their
  codes are compared by what they stand for, and the best `rescore` rows of each query are scored exactly from their vectors.
  No other vector is read.
* **Metrics**: an index serves the metric that it was built for. Cosine is distance between unit vectors; dot products become distances by one more
  dimension, which fills every row up to the largest length at the time of building (longer rows that come later are found less surely).
* **Filters** (`only`) are applied to the codes before cells are chosen: cells count what passes, so that enough rows pass however few do.
* **Versions**: refreshed ids replace their old rows, and deleted ones go (see versions).

Rows without a vector or id are left out; all vectors of an index have one length. Of rows with the same id in one write, all stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import versions
from lodestone.operators.frozen import frozen
from lodestone.operators.ranking import top_n
from lodestone.operators.search import CORPUS_BLOCK, QUERY_BLOCK, QUERY_SLICE, vector_search
from lodestone.shipping import ship

#: Bounds of the sample that groups and codes are fitted on, in rows and in numbers, and of the rows that a group's cells are fitted on.
SAMPLE_ROWS, SAMPLE_VALUES, GROUP_ROWS = 50_000, 1 << 24, 20_000
MOST_GROUPS, MOST_CELLS, CELLS_OF_GROUP = 256, 1 << 16, 1 << 12
PIECE, CODES = 2, 256
#: Rows of a group that one task places; larger groups are split.
PLACE_ROWS = 500_000
METRICS = ("cosine", "dot", "l2")
ROWS = "id long, cell int, code binary, vector array<float>, grp int"


@dataclass(frozen=True)
class Model:
    """metric; length that rows are filled up to (dot); centres of the groups; the 256 pieces of each place."""

    metric: str
    length: float
    groups: np.ndarray
    pieces: np.ndarray

    def prepared(self, x: np.ndarray, asks: bool = False) -> np.ndarray:
        return prepared(x, self.metric, self.length, asks)


def prepared(x: np.ndarray, metric: str, length: float, asks: bool = False) -> np.ndarray:
    """Vectors whose distances order like the metric, filled up to whole pieces."""
    x = np.asarray(x, np.float32)
    if metric == "cosine":
        size = np.sqrt((x**2).sum(axis=1, keepdims=True))
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    if metric == "dot":
        more = np.zeros(len(x), np.float32) if asks else np.sqrt(np.maximum(length**2 - (x**2).sum(axis=1), 0))
        x = np.column_stack([x, more])
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PIECE)))


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 8192) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[a : a + step] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), step)] or [np.empty(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centres of at most k cells; a centre that loses its rows stays where it was."""
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])].astype(np.float32)
    for _ in range(rounds if len(x) > k else 0):
        own = nearest(x, centres)
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres).astype(np.float32)
    return centres


def _matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1) if len(column) else np.empty((0, PIECE), np.float32)


def _rows(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")


def grouped(df: DataFrame, metric: str, length: float, groups: np.ndarray) -> DataFrame:
    """Adds `grp`, the nearest group's number."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", grp int"

    def run(batches):
        for b in batches:
            own = nearest(prepared(_matrix(b.column("vector")), metric, length), groups) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], [*b.schema.names, "grp"])

    return df.mapInArrow(run, schema)


def _cells_of_groups(rows: DataFrame, metric: str, length: float, cells: int) -> DataFrame:
    """(grp, cell, centre): k-means within each group, over at most GROUP_ROWS of its rows chosen by a hash of their ids."""

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        x = prepared(_matrix(table.column("vector")), metric, length)[np.argsort(table.column("id").to_numpy(), kind="stable")]
        centres = k_means(x, cells)
        ids = grp * CELLS_OF_GROUP + np.arange(len(centres))
        return pa.table({"grp": pa.array([grp] * len(centres), pa.int32()), "cell": pa.array(ids, pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float32()))})

    some = top_n(rows.withColumn("_h", F.xxhash64("id")), ["grp"], [F.asc("_h"), F.asc("id")], GROUP_ROWS, "_nth")
    return some.select("grp", "id", "vector").groupBy("grp").applyInArrow(fit, "grp int, cell int, centre array<float>")


def placed(rows: DataFrame, cells: DataFrame, metric: str, length: float, pieces: np.ndarray | None = None) -> DataFrame:
    """Rows (id, vector, grp) with their nearest cell of the group and their code; without pieces, with what is left beside the centre.

    A group's centres come first in each partition that has rows of it; large groups are split over several.
    """
    splits = rows.groupBy("grp").agg(F.ceil(F.count("*") / PLACE_ROWS).cast("int").alias("_n"))  # one row a group, MOST_GROUPS at most
    nothing = lambda t: F.lit(None).cast(t)
    data = rows.join(F.broadcast(splits), "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("split"), "id", nothing("int").alias("cell"), "vector", nothing("array<float>").alias("centre"))
    heads = cells.join(F.broadcast(splits), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("split"), nothing("long").alias("id"), "cell", nothing("array<float>").alias("vector"), "centre")
    last = "code binary" if pieces is not None else "rest array<float>"

    def run(batches):
        place, ids, centres, known = None, [], [], None
        for b in batches:
            keys = list(zip(b.column("grp").to_pylist(), b.column("split").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if keys[a] != place:
                    place, ids, centres, known = keys[a], [], [], None
                part = b.slice(a, z - a)
                is_head = np.asarray(part.column("centre").is_valid())
                head, own = part.filter(pa.array(is_head)), part.filter(pa.array(~is_head))
                if head.num_rows:
                    ids += head.column("cell").to_pylist()
                    centres.append(_matrix(head.column("centre")))
                if not own.num_rows:
                    continue
                known = np.concatenate(centres) if known is None else known
                x = prepared(_matrix(own.column("vector")), metric, length)
                at = nearest(x, known)
                rest = x - known[at]
                if pieces is None:
                    more = pa.array(rest.tolist(), pa.list_(pa.float32()))
                else:
                    codes = np.stack([nearest(rest[:, k * PIECE : (k + 1) * PIECE], p) for k, p in enumerate(pieces)], axis=1).astype(np.uint8)
                    more = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(np.array(ids, np.int32)[at]), more, own.column("vector"), own.column("grp")], ["id", "cell", last.split()[0], "vector", "grp"])

    both = heads.unionByName(data).repartition("grp", "split").sortWithinPartitions("grp", "split", F.asc_nulls_first("id"))
    return both.mapInArrow(run, f"id long, cell int, {last}, vector array<float>, grp int")


def build(corpus: DataFrame, path: str, metric: str = "cosine", cells: int | None = None) -> None:
    """Fit and write the index of (id, vector). Without `cells` there are as many as the square root of the number of rows."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    spark = corpus.sparkSession
    if versions.latest(spark, path).version:
        raise ValueError(f"there is an index at {path}")
    ship(spark)
    rows = _rows(corpus)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.min(F.size("vector")).alias("least"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    if not facts["n"]:
        raise ValueError("an index is fitted on some rows")
    if facts["dims"] != facts["least"]:
        raise ValueError("vectors of different lengths")
    length = float(np.sqrt(facts["square"]))
    cells = min(MOST_CELLS, cells or max(1, round(facts["n"] ** 0.5)))
    groups = min(MOST_GROUPS, max(1, round(cells**0.5)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(CODES, min(SAMPLE_ROWS, SAMPLE_VALUES // facts["dims"])))
    centres = k_means(prepared(_matrix(sample.toArrow().column("vector")), metric, length), groups)
    of_groups = grouped(rows, metric, length, centres)
    _cells_of_groups(of_groups, metric, length, -(-cells // groups)).write.parquet(f"{path}/model/cells")
    stored = spark.read.schema("grp int, cell int, centre array<float>").parquet(f"{path}/model/cells")
    rest = _matrix(placed(grouped(sample, metric, length, centres), stored, metric, length).orderBy("id").select("rest").toArrow().column("rest"))  # the bounded sample again
    pieces = np.stack([_filled(k_means(np.ascontiguousarray(rest[:, a : a + PIECE]), CODES)) for a in range(0, rest.shape[1], PIECE)])
    spark.createDataFrame([(metric, length, centres.tolist(), pieces.tolist())], "metric string, length double, groups array<array<float>>, pieces array<array<array<float>>>").write.parquet(f"{path}/model/facts")
    refresh(corpus, path)


def _filled(pieces: np.ndarray) -> np.ndarray:
    """CODES pieces, the last one repeated where fewer were fitted."""
    return np.concatenate([pieces, np.repeat(pieces[-1:], CODES - len(pieces), axis=0)])


def model_of(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model/facts").first()
    return Model(r["metric"], r["length"], np.array(r["groups"], np.float32), np.array(r["pieces"], np.float32))


def refresh(new: DataFrame, path: str) -> None:
    """Add (id, vector) under the index's own cells; rows of ids that it has already take the place of the old ones."""
    spark, name = new.sparkSession, versions.fresh("segment")
    ship(spark)
    now, m = versions.latest(spark, path), model_of(spark, path)
    cells = spark.read.schema("grp int, cell int, centre array<float>").parquet(f"{path}/model/cells")
    own = placed(grouped(_rows(new), m.metric, m.length, m.groups), cells, m.metric, m.length, m.pieces)
    own.sortWithinPartitions("grp", "cell", "id").write.partitionBy("grp").parquet(f"{path}/{name}/rows")
    stored = spark.read.schema(ROWS).parquet(f"{path}/{name}/rows")
    versions.publish(spark, path, now.after(name, _mark(stored.select("id"), path, now)))


def delete(ids: DataFrame, path: str) -> None:
    """Remove the ids of a table (id); ids that the index lacks change nothing."""
    now = versions.latest(ids.sparkSession, path)
    versions.publish(ids.sparkSession, path, now.after(None, _mark(ids.select(F.col("id").cast("long").alias("id")), path, now)))


def _mark(ids: DataFrame, path: str, now: versions.Manifest) -> str | None:
    if not now.segments:
        return None
    name = versions.fresh("marker")
    ids.where("id IS NOT NULL").distinct().write.parquet(f"{path}/{name}/ids")
    return name


drop = versions.drop


@dataclass(frozen=True)
class Search:
    """One search: the cells that each query takes with their rows, the candidates by code, and the hits."""

    total: int
    taken: DataFrame
    candidates: DataFrame
    hits: DataFrame

    def report(self) -> DataFrame:
        """(query_id, codes, vectors, share): codes compared and vectors read for each query, the latter also as a share of the rows."""
        codes = self.taken.groupBy("query_id").agg(F.sum("n").alias("codes"))
        return codes.join(self.candidates.groupBy("query_id").agg(F.count("*").alias("vectors")), "query_id").withColumn("share", F.col("vectors") / self.total)


def _exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The metric of rows with rows."""
    if metric == "l2":
        return -np.sqrt(((x - y) ** 2).sum(axis=1))
    s = (x * y).sum(axis=1)
    if metric == "cosine":
        size = np.sqrt((x**2).sum(axis=1) * (y**2).sum(axis=1))
        s = np.divide(s, size, out=np.full(len(s), np.nan), where=size > 0)
    return s


def searched(queries: DataFrame, path: str, top: int, scan: float = 0.5, rescore: int | None = None, metric: str | None = None, only: DataFrame | None = None, skip_self: bool = True) -> Search:
    """The best `top` rows of each query (query_id, vector) among `rescore` (ten times top) candidates from cells with the share `scan` of all rows.

    metric: only to be sure that the index has it. only: ids (id) that may be found. The version that is the last one now is searched.
    """
    spark = queries.sparkSession
    ship(spark)
    now, m = versions.latest(spark, path), model_of(spark, path)
    if metric not in (None, m.metric):
        raise ValueError(f"this index is for {m.metric}")
    if not 0 < scan <= 1:
        raise ValueError("scan is a share of the rows")
    rescore = rescore or 10 * top
    everything = versions.segment_rows(spark, path, now, "rows", ROWS)
    rows = versions.live(everything.select("seg", "grp", "id", "cell", "code"), path, now)
    if only is not None:
        rows = frozen(rows.join(only.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"))
    sizes = frozen(rows.groupBy("grp", "cell").agg(F.count("*").alias("n")))  # one row a cell
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = max(rescore, int(np.ceil(scan * total)))
    asked = frozen(_prepared_queries(_rows(queries, "query_id"), m))
    cells = spark.read.schema("grp int, cell int, centre array<float>").parquet(f"{path}/model/cells").join(sizes, ["grp", "cell"])
    ranked = vector_search(asked.select(F.col("id").alias("query_id"), F.col("point").alias("vector")), cells.select(F.col("cell").alias("id"), F.col("centre").alias("vector")), MOST_CELLS, "l2", skip_self=False)
    before = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("score"), "cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    taken = ranked.select("query_id", F.col("id").cast("int").alias("cell"), "score").join(cells, "cell").withColumn("_before", before).where(F.col("_before") < enough)
    taken = frozen(taken.select("query_id", "grp", "cell", "n", "centre"))
    candidates = frozen(top_n(_by_code(taken.join(asked.select(F.col("id").alias("query_id"), "point"), "query_id"), rows, m, rescore, skip_self), ["query_id"], [F.asc("distance"), F.asc("id")], rescore))
    chosen = candidates.select("query_id", "seg", "grp", "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("own")), "query_id")
    met = everything.select("seg", "grp", "id", "vector").join(chosen, ["seg", "grp", "id"]).select("query_id", "id", "vector", "own")

    def score(batches):
        for b in batches:
            s = np.round(_exact(_matrix(b.column("own")).astype(float), _matrix(b.column("vector")).astype(float), m.metric), 6) + 0.0
            keep = pa.array(~np.isnan(s))
            yield pa.RecordBatch.from_arrays([b.column("query_id").filter(keep), b.column("id").filter(keep), pa.array(s).filter(keep)], ["query_id", "id", "score"])

    hits = top_n(met.mapInArrow(score, "query_id long, id long, score double"), ["query_id"], [F.desc("score"), F.asc("id")], top).drop("rank")
    return Search(total, taken, candidates, hits)


def _prepared_queries(queries: DataFrame, m: Model) -> DataFrame:
    """(id, vector, point): the vector as asked for and as the index compares it."""

    def run(batches):
        for b in batches:
            point = m.prepared(_matrix(b.column("vector")), asks=True) if b.num_rows else np.empty((0, PIECE))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(point.tolist(), pa.list_(pa.float32()))], ["id", "vector", "point"])

    return queries.mapInArrow(run, "id long, vector array<float>, point array<float>")


def _by_code(taken: DataFrame, rows: DataFrame, m: Model, best: int, skip_self: bool) -> DataFrame:
    """(query_id, seg, grp, id, distance): the best rows of each query and block by their codes. Cells and their queries meet in blocks of bounded size."""
    sizes = taken.groupBy("cell").agg(F.max("n").alias("_n"), F.count("*").alias("_asking"))
    sizes = sizes.select("cell", F.ceil(F.col("_asking") / QUERY_BLOCK).cast("int").alias("_q"), F.ceil(F.col("_n") / CORPUS_BLOCK).cast("int").alias("_c"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    nothing = lambda t: F.lit(None).cast(t)
    q = taken.join(sizes, "cell").withColumn("q", own("query_id", "_q")).withColumn("c", every("_c"))
    c = rows.join(sizes, "cell").withColumn("c", own("id", "_c")).withColumn("q", every("_q"))
    q = q.select("cell", "q", "c", F.lit(True).alias("asks"), nothing("int").alias("seg"), "grp", F.col("query_id").alias("id"), nothing("binary").alias("code"), "point", "centre")
    c = c.select("cell", "q", "c", F.lit(False).alias("asks"), "seg", "grp", "id", "code", nothing("array<float>").alias("point"), nothing("array<float>").alias("centre"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        out = [[], [], [], [], []]
        query, target = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if query.num_rows and target.num_rows:
            target = target.take(pa.array(np.argsort(ids[~asks], kind="stable")))
            names, segs, grp = (target.column(x).to_numpy() for x in ("id", "seg", "grp"))
            codes = np.frombuffer(b"".join(target.column("code").to_pylist()), np.uint8).reshape(len(names), -1)
            named = m.pieces[np.arange(codes.shape[1]), codes].reshape(len(names), -1).astype(float)  # what the codes stand for, beside the centre
            size = (named**2).sum(axis=1)
            rest, asking = (_matrix(query.column("point")) - _matrix(query.column("centre"))).astype(float), query.column("id").to_pylist()
            for begin in range(0, len(asking), QUERY_SLICE):
                r = rest[begin : begin + QUERY_SLICE]
                distances = ((r**2).sum(axis=1)[:, None] + size - 2 * (r @ named.T)).astype(np.float32)  # equal codes are equally far, in any block
                for qid, distance in zip(asking[begin : begin + QUERY_SLICE], distances, strict=True):
                    at = np.flatnonzero(names != qid) if skip_self else np.arange(len(names))
                    at = at[np.argsort(distance[at], kind="stable")[:best]]
                    for k, x in enumerate((np.full(len(at), qid), segs[at], grp[at], names[at], distance[at])):
                        out[k].append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(x).astype(t.to_pandas_dtype()) if x else [], t) for n, x, t in zip(("query_id", "seg", "grp", "id", "distance"), out, kinds, strict=True)})

    return q.unionByName(c).groupBy("cell", "q", "c").applyInArrow(compare, "query_id long, seg int, grp int, id long, distance double")


def search(queries: DataFrame, path: str, top: int, scan: float = 0.5, rescore: int | None = None, metric: str | None = None, only: DataFrame | None = None, skip_self: bool = True) -> DataFrame:
    """(query_id, id, score): see searched()."""
    return searched(queries, path, top, scan, rescore, metric, only, skip_self).hits


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact results (query_id, id) that were found."""
    both = exact.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("_hit")).distinct(), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
