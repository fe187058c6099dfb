"""A small Python function over a column of texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.shipping import ship


#: Tasks for each core that rows are dealt to before a costly function.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The frame dealt evenly to all cores: a table of many rows may be a file of a few MB, which Spark reads as one or two tasks."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def flat_rows(df: DataFrame, column: str, function: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """The frame's other columns beside each row that the function gives for the column's value; null values give none."""
    spark = df.sparkSession
    ship(spark)
    carried = [c for c in df.columns if c != column]
    fields = StructType.fromDDL(schema).fields
    types = [to_arrow_type(f.dataType) for f in fields]
    whole = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != column), schema])

    def run(batches):
        for b in batches:
            found = [(i, row) for i, v in enumerate(b.column(column).to_pylist()) if v is not None for row in function(v)]
            at = pa.array([i for i, _ in found], pa.int32())
            made = [pa.array([row[k] for _, row in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carried), *made], [*carried, *(f.name for f in fields)])

    return df.mapInArrow(run, whole)
