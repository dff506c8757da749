"""Exact deduplication with streaming state that never expires.

A file stream over the documents feeds a keyed aggregation whose state lives in RocksDB
on the executors' disks and is checkpointed in the shared folder. Per digest of a text
the state retains the number of rows, the identifier of the row that stays (the largest
doc_id) and that row's content locator (file and row in the file). No watermark: a
digest is never forgotten. The state is then read as a table.

A hit is a row whose digest the state holds more than once. Hits are found by a bitmap
of fixed size over the digests' hashes (a few false positives only cost work), so rows
without a copy are never shuffled. Each hit's full bytes are checked against the bytes
at its group's locator. Rows of a digest under which different texts met are grouped
anew by their whole text, so a digest's collisions can't merge texts.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.common import drop_path, materialise, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of the bitmap of repeated digests: 2^23 bits are 256 rows of 4 KB, 1 MB to broadcast whatever the input.
BITMAP_BITS = 1 << 23
#: Bytes of RocksDB memory an executor may take for all its state partitions together, in MB.
STATE_MEMORY_MB = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(docs: DataFrame, digest, keep_all: bool = False) -> DataFrame:
    """Digest, identifier and locator of each row, with its text and, if asked, its whole row as ``whole``."""
    names = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    more = [F.struct(*[docs[c] for c in names]).alias("whole")] if keep_all else []
    return docs.select(
        digest(text).alias("digest"),
        docs["doc_id"].alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        text.alias("text"),
        *more,
    )


def registry(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """Stream the Parquet documents at ``path`` through the keyed state and return it: digest, n, keep.

    keep is a struct of doc_id, file and row of the row that stays. With a folder ``state``
    the state stays there: a later call takes only the files that have come to ``path``
    since, and a driver that starts anew goes on from the last whole batch.
    """
    checkpoint = state or scratch(spark, "exact-dedup-state")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    counted = (
        _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest)  # a glob: the stream takes a folder or a single file
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    )
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MEMORY_MB),
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = (
            counted.writeStream.format("noop")
            .outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", checkpoint)
            .start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        n, keep = kept.schema["value"].dataType.names
        found = materialise(
            kept.select("key.digest", F.col(f"value.{n}").alias("n"), F.col(f"value.{keep}").alias("keep")), "exact-dedup"
        )
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not state:
        drop_path(spark, checkpoint)
    return found


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITMAP_BITS)) + 1


def _marked(rows: DataFrame, reg: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether the bitmap holds the digest's bit, as it does for every repeated digest."""
    bits = (
        reg.where("n > 1")
        .select(_bit(F.col("digest")).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    at = rows.withColumn("bit", _bit(F.col("digest"))).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    joined = at.join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(at div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr("shiftleft(1, CAST(at % 8 AS INT))")) != 0
    return joined.withColumn("hit", is_set).drop("bit", "bucket", "at", "bits")


def _settled(hits: DataFrame, reg: DataFrame) -> DataFrame:
    """``hits`` with keep_id, group_size and kept, after the check of their full bytes."""
    spots = reg.where("n > 1").select("digest", "n", "keep")
    at = spots.select(F.col("keep.file").alias("file"), F.col("keep.row").alias("row"), F.col("digest").alias("d"), "n", "keep")
    spot = hits.join(at, ["file", "row"]).where("d = digest").select("digest", "n", "keep", F.col("text").alias("kept_text"))
    # written, so that the join below deals both its sides anew and Spark can split a hot group's rows
    groups = materialise(spot, "exact-dedup-groups")
    checked = hits.join(groups, "digest", "left").withColumn("same", F.coalesce(F.col("text") == F.col("kept_text"), F.col("n").isNull()))
    mixed = materialise(checked.where("NOT same").select("digest"), "exact-dedup-mixed")  # no distinct: it would tie the join's tasks to keys
    own = F.struct("doc_id", "file", "row")
    out = checked.drop("kept_text", "same")
    if not mixed.isEmpty():  # digests under which different texts met: the whole text decides
        again = hits.join(mixed, "digest", "left_semi").groupBy("digest", "text").agg(F.count("*").alias("n2"), F.max(own).alias("keep2"))
        out = out.join(again, ["digest", "text"], "left").withColumn("n", F.coalesce("n2", "n")).withColumn("keep", F.coalesce("keep2", "keep")).drop("n2", "keep2")
    return (
        out.withColumn("kept", F.coalesce((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")), F.lit(True)))
        .withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")))
        .withColumn("group_size", F.coalesce("n", F.lit(1).cast("long")))
        .drop("n", "keep")
    )


def duplicates(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of the Parquet documents at ``path``, dropped ones too.

    doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256. A null
    text counts as empty; texts of any length are compared whole. Of equal texts the largest doc_id stays; among rows that share
    it, or if all are null, the last by file and place does, so exactly one row of a group
    is kept. Extra columns are ignored; an empty table gives no rows.
    """
    reg = registry(spark, path, digest, files_per_batch)
    rows = _marked(_rows(spark.read.parquet(path), digest), reg)
    hits = materialise(rows.where("hit").drop("hit"), "exact-dedup-hits")
    hex_of = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    alone = rows.where("NOT hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_of
    )
    return alone.unionByName(_settled(hits, reg).select("doc_id", "keep_id", "group_size", "kept", hex_of))


def keep_distinct(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the Parquet documents at ``path`` that stay, with all their columns."""
    docs = spark.read.parquet(path)
    reg = registry(spark, path)
    rows = _marked(_rows(docs, sha256, keep_all=True), reg)
    hits = materialise(rows.where("hit").drop("hit"), "exact-dedup-hits")
    kept = rows.where("NOT hit").select("whole.*").unionByName(_settled(hits, reg).where("kept").select("whole.*"))
    return kept


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark, f"{sf_dir}/documents.parquet")


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
