"""What the operators share: code shipping, the shared folder, Arrow batches in bounded slices."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one slice of an Arrow batch may hold (one longer row makes a slice of its own).
SLICE_BYTES = 4 << 20

#: Bytes of an Arrow batch between Spark and a Python worker, where the session doesn't say otherwise: texts are long, and Spark's own limits
#: (10,000 rows, 64 MB) are held several times over by both sides.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; bound the batches that they get."""
    if spark.conf.get(BATCH_SETTING).strip("b") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "lodestone_shipped.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new one where that is unset in local mode (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = _local_shared(sc.applicationId)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_local: dict[str, str] = {}


def _local_shared(app: str) -> str:
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lodestone-shared-")
        import shutil

        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in any store that Spark knows; a session that has ended is no error."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Within this block Spark deletes the shuffle files of a query as soon as it has ended."""
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SETTING, before)


def staged(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here and a lost executor loses none of it.

    done: staged tables that nothing needs from here on; they are deleted.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables."""
    for t in tables:
        remove_path(t.sparkSession, t._lodestone_path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named string column holds about `most` bytes in each piece."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def map_slices(df: DataFrame, make: Callable, schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Apply make()(batch) -> batch to slices of a frame; make is called once in each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for piece in slices(batches, column, most):
            work = work or make()
            yield work(piece)
        del work
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give a worker's freed memory back to the system: workers live on and would hold it beside the next task's."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back by hand


def free(name: str, taken: Iterable[str]) -> str:
    """The name with as many underscores before it as make it different from the taken ones (names differ by more than case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Keys with more than this part of the rows are spread; so there are this many of them at most, which bounds their broadcast.
HOT_PARTS, SALTS = 1024, 64


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """Join a table to one with a row for each key, whose column `rows` says how many rows of the first have it.

    Keys with more than total / HOT_PARTS rows (HOT_PARTS keys at most) are dealt out over SALTS tasks by the column `by`.
    """
    hot = F.col(rows) > F.lit(total) / HOT_PARTS
    marks = one.where(hot & F.col(key).isNotNull()).select(key, F.lit(SALTS).alias("_salts"))
    salted = many.join(F.broadcast(marks), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))))
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, SALTS - 1).otherwise(0).cast("long"))))
    return salted.drop("_salts").join(copies.drop(rows), [key, "_salt"], how).drop("_salt")
