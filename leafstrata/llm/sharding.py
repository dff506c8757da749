"""Two-pass external shuffle into shards of equal row counts (law ``rows``).

Pass 1 scatters the documents uniformly into buckets of a size that fits in a task's
memory, by a seeded hash of the row. Pass 2 applies a Fisher-Yates permutation to each
bucket and writes it. The buckets in order, each permuted, are the global order; shards
are its consecutive ranges, so a bucket writes to few shards and counts differ by one at
most. A bucket's place follows from bucket counts taken beforehand, so that no task
waits for another and the permuted rows go straight to committed files: a task that is
run again can't deal a slot twice.

Only DataFrame and SQL functions are used. ``shuffle`` is Spark's Fisher-Yates; its
generator starts from the seed and the partition's number. A bucket is a partition of its
own and is sorted first, so the order is a function of the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstrata.llm.common import materialise, numbered, scratch, table

#: UTF-8 bytes of text plus the fixed 16 a row that a bucket is meant to hold.
BUCKET_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _slots(total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of the global position ``place``: the first total % shards shards take one row more."""
    q, more = divmod(total, shards)
    place, edge = F.col("place"), F.lit(more * (q + 1))
    big = F.expr(f"place div {q + 1}")
    small = F.lit(more) + F.expr(f"(place - {more * (q + 1)}) div {max(q, 1)}")
    shard = F.when(place < edge, big).otherwise(small).cast("int")
    start = F.when(place < edge, big * (q + 1)).otherwise(edge + (small - more) * q)
    return shard, (place - start).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs`` (any columns, among them doc_id and text) under ``path`` as shard=0 .. shards-1.

    Files hold the struct ``doc`` of all columns and ``slot``, gapless from 0 in each shard.
    Null texts weigh 16 bytes and stay null; equal texts are dealt like any others, since
    a row's hash starts from its doc_id, and rows that are equal in all columns are numbered
    and dealt one by one. A text longer than a bucket has a bucket of its own size. With
    fewer rows than shards the last shards stay empty; an empty table writes no rows. The
    layout is a function of rows, shards, seed and bucket size, however the rows come
    partitioned.
    """
    names = docs.columns
    text, key = docs["text"], docs["doc_id"]
    size = size_of(text)
    mark = F.xxhash64(F.lit(seed), key, size, F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.select(mark.alias("mark"), size.alias("size"), F.struct(*[docs[c] for c in names]).alias("doc"))
    total, weight = rows.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(weight or 0) // bucket_bytes))
    rows = numbered(rows, "mark", "doc")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mark", "occurrence"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # in one task, but one short row a bucket: choose bucket_bytes for a few million at most
    starts = materialise(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-starts")
    dealt = rows.repartitionById(int(buckets), F.col("bucket")).groupBy("bucket")
    held = dealt.agg(F.sort_array(F.collect_list(F.struct("mark", "occurrence", "doc"))).alias("held"))
    order = held.select("bucket", F.shuffle("held", seed).alias("held")).join(starts, "bucket")
    shard, slot = _slots(total, shards)
    (
        order.select("start", F.posexplode("held").alias("at", "row"))
        .select(F.col("row.doc").alias("doc"), (F.col("start") + F.col("at")).alias("place"))
        .select("doc", shard.alias("shard"), slot.alias("slot"))
        .write.partitionBy("shard")
        .parquet(path)
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc, slot, shard of what write_shards() has written."""
    return spark.read.parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    text = F.col("doc.text")
    return read_shards(spark, path).select(
        F.col("doc.doc_id").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
