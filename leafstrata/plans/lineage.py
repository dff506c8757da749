"""Cutting lineage in iterative plans."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one below the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def run_folder(spark: SparkSession, name: str):
    """A folder of this run's own in the shared folder, gone with all that it holds when the block ends, however it ends."""
    path = f"{shared_dir(spark)}/{name}-{time.time_ns()}-{uuid.uuid4().hex}"
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(of)
    try:
        yield path
    finally:
        fs.delete(of, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
