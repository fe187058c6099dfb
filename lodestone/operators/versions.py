"""Versions of a stored index: immutable segments and delete markers, named by manifests of which readers take the last.

`{path}/versions/{n}.json` names what version n consists of: segments in the order in which they came, and marker tables of ids,
each good for the segments before it. A writer claims the number after the version that it started from and publishes its manifest by one
rename; so a reader sees one version or the next, never a mixture, and of two writers that started from the same version one fails.
Files go through Spark's own file system interface, so an index may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Manifest:
    """segments: names of folders; markers: (name of a table of ids, number of segments it is good for); totals: what the index sums up."""

    version: int = 0
    segments: tuple[str, ...] = ()
    markers: tuple[tuple[str, int], ...] = ()
    totals: dict = field(default_factory=dict)

    def after(self, segment: str | None = None, marker: str | None = None, **totals) -> Manifest:
        """The next version: a marker deletes from the segments so far, then the segment joins them; totals are added up."""
        markers = (*self.markers, (marker, len(self.segments))) if marker else self.markers
        return Manifest(self.version + 1, (*self.segments, segment) if segment else self.segments, markers, {k: self.totals.get(k, 0) + totals.get(k, 0) for k in {**self.totals, **totals}})


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def latest(spark: SparkSession, path: str) -> Manifest:
    """The last published manifest; version 0 where there is no index."""
    files, at = _files(spark, path)
    folder = at(f"{path}/versions")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
    if not numbers:
        return Manifest()
    text = spark.read.text(f"{path}/versions/{max(numbers):08d}.json", wholetext=True).first()[0]  # one small file
    found = json.loads(text)
    return Manifest(found["version"], tuple(found["segments"]), tuple((n, k) for n, k in found["markers"]), found["totals"])


def publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a manifest the last version. Fails if its number is taken: another writer came first, or broke off (see release())."""
    files, at = _files(spark, path)
    files.mkdirs(at(f"{path}/versions"))
    target = f"{path}/versions/{manifest.version:08d}"
    if not files.createNewFile(at(f"{target}.claim")):
        raise RuntimeError(f"version {manifest.version} of {path} is claimed by another writer")
    draft = at(f"{path}/versions/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    if not files.rename(draft, at(f"{target}.json")):
        raise RuntimeError(f"version {manifest.version} of {path} could not be published")


def release(spark: SparkSession, path: str) -> None:
    """Free the number that a writer claimed and never published, once that writer is known to have ended."""
    files, at = _files(spark, path)
    files.delete(at(f"{path}/versions/{latest(spark, path).version + 1:08d}.claim"), False)


def clean(spark: SparkSession, path: str) -> int:
    """Delete the segments and markers that only earlier versions name, when no reader uses those any more; returns how many."""
    files, at = _files(spark, path)
    now = latest(spark, path)
    kept = {"versions", "model", *now.segments, *(n for n, _ in now.markers)}
    gone = [s.getPath() for s in files.listStatus(at(path)) if s.getPath().getName() not in kept]
    for p in gone:
        files.delete(p, True)
    return len(gone)


def drop(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at(path), True)


def fresh(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def segment_rows(spark: SparkSession, path: str, manifest: Manifest, table: str, schema: str) -> DataFrame:
    """A table of all segments, with the column `seg`, the segment's place."""
    parts = [spark.read.schema(schema).parquet(f"{path}/{name}/{table}").withColumn("seg", F.lit(k)) for k, name in enumerate(manifest.segments)]
    out = parts[0] if parts else spark.createDataFrame([], schema).withColumn("seg", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Ids up to which a table of ids is broadcast to wide rows; with more of them, both sides are shuffled.
SENT_IDS = 1 << 20


def is_few(ids: DataFrame) -> bool:
    return ids.count() <= SENT_IDS


def sent(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if they are few."""
    return F.broadcast(ids) if is_few(ids) else ids


def marks(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    """(id, _before) of all markers: the ids that they delete from the first segments, and from how many."""
    parts = [spark.read.schema("id long").parquet(f"{path}/{name}/ids").withColumn("_before", F.lit(before)) for name, before in manifest.markers]
    return reduce(DataFrame.unionByName, parts)


def live(rows: DataFrame, path: str, manifest: Manifest, key: str = "id", wide: bool = False) -> DataFrame:
    """The rows of segments (with `seg`) that no marker deletes. wide: rows that cost more to shuffle than the markers' ids to count."""
    if not manifest.markers:
        return rows
    own = marks(rows.sparkSession, path, manifest)
    last = own.groupBy("id").agg(F.max("_before").alias("_before")).withColumnRenamed("id", "_gone")
    last = F.broadcast(last) if wide and is_few(own) else last
    return rows.join(last, (F.col(key) == F.col("_gone")) & (F.col("seg") < F.col("_before")), "left_anti")
