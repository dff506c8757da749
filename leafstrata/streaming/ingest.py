"""File-stream ingest: bounded batches into a committed table, duplicates dropped by state that never expires."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.plans.lineage import shared_dir


def ingest(spark: SparkSession, source: str, key: str, time: str, files_per_batch: int = 16) -> DataFrame:
    """All rows of the Parquet files at ``source`` once per ``key``, through a stream with bounded batches.

    ``files_per_batch`` is the back-pressure. Keyed state without a watermark drops repeats
    however late they come, and no row is too late; it grows with the number of keys. The
    sink commits files exactly once.
    """
    out = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{source[:-1]}[{source[-1]}]")
    once = stream.withColumn(time, F.col(time).cast("timestamp")).dropDuplicates([key])
    query = once.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def gaps(events: DataFrame, seconds: int) -> DataFrame:
    """Sessions of each user: a pause over ``seconds`` opens one, as a wide gap opens a word."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    opened = events.withColumn("opens", F.coalesce((pause > seconds * 1_000_000).cast("int"), F.lit(0)))
    numbered = opened.withColumn("session_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))
