"""Helpers shared by the corpus operators: shared-folder tables, paths and label samples."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset in local mode
    (tests) a folder below the warehouse is used and set as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of ours in the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rerun of a scan, not of what
    made the table, and a table that is read twice is computed once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that materialise() has written, once nothing that reads them is left to be computed."""
    for df in written:
        drop_path(df.sparkSession, df._written_at)


#: Short rows of ids up to which a written list is broadcast (a few MB); beyond, Spark joins by shuffle.
BROADCAST_IDS = 500_000


def small(written: DataFrame) -> DataFrame:
    """``written`` with a broadcast hint if a count proves it small. Give it a materialised list of ids."""
    return F.broadcast(written) if written.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else written


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what its allocators keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        pass


def lean(run):
    """``run``, a function over Arrow batches for mapInArrow, that gives memory back when its task is through."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def repeated(rows: DataFrame, mark: str) -> DataFrame:
    """The marks that several rows have, as a written table with the column _mark."""
    return materialise(rows.groupBy(F.col(mark).alias("_mark")).count().where("count > 1").select("_mark"), "repeated")


def numbered(rows: DataFrame, mark: str, row: str, again: DataFrame | None = None) -> DataFrame:
    """``rows`` (any columns) with ``occurrence``: 1, 2, ... for rows that are equal in the column ``row``, in one order or another.

    Rows equal in ``row`` must be equal in all columns, and have one ``mark``, a long that
    other rows share rarely. Only rows whose mark repeats are grouped, with partial
    aggregates, so that any number of equal rows is one row in a shuffle. ``again`` is
    repeated(), where it is known already.
    """
    if again is None:
        again = repeated(rows, mark)
    if again.isEmpty():
        return rows.withColumn("occurrence", F.lit(1))
    side = small(again)
    once = rows.join(side, rows[mark] == side["_mark"], "left_anti").withColumn("occurrence", F.lit(1))
    others = [c for c in rows.columns if c not in (mark, row)]
    more = rows.join(side, rows[mark] == side["_mark"], "left_semi").groupBy(mark, row).agg(F.count("*").cast("int").alias("_n"), *[F.first(c).alias(c) for c in others])
    return once.unionByName(more.withColumn("occurrence", F.explode(F.expr("sequence(1, _n)"))).select(*rows.columns, "occurrence"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else ``df`` carries (also names that differ in case only)."""
    exact = {}
    for i, c in enumerate(df.columns):
        exact.setdefault(c, i)
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{exact[n]}").alias(n) for n in names])


def crc_remainder(column: str, modulus: int):
    """crc32 of a column's text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def training_rows(labels: DataFrame, docs: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """Up to ``limit`` labelled documents (doc_id, text, label) outside the held-out remainder.

    The rows are those with the smallest hashed ids: a bounded sample, which is why
    the label side is broadcast. Labels other than 0 and 1 and null ids take no part;
    of repeated ids the larger label counts, and of their texts the last in order, so that
    repeated documents don't add rows.
    """
    lab = (
        pick(labels, "doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(crc_remainder("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
