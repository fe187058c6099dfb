"""Cutting lineage: rows whose place was decided once must not be dealt out anew."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; one of our own only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def frozen(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()
