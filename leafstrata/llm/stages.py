"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the next one's documents.

All but the last keep the columns of ``docs``, also extra ones. A null text counts as empty;
texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstrata.llm import mixing, pieces, quality as quality_model, similar
from leafstrata.llm.common import scratch, table
from leafstrata.llm.exact_dedup import keep_distinct


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the given documents. Repeated rows stay or go together."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.keep(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, with the largest doc_id (null is the smallest). The rows are written in the shared folder first: the operator streams files."""
    path = scratch(spark, "exact-dedup-input")
    docs.write.parquet(path)
    return keep_distinct(spark, path).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarity of 0.8 or more."""
    return similar.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights and dealt anew; repeats are rows of their own. Rows without doc_id, or equal to another, draw for themselves."""
    return mixing.poisson_mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids under merge-dropout, with the check that they decode to the text.

    Rows that the mixing repeated are numbered, so that each is segmented in its own way.
    Empty texts have no ids and decode to themselves.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    numbered = docs.select("doc_id", "text", F.row_number().over(same).alias("copy"))
    return pieces.encode_documents(numbered, copy="copy").select("doc_id", F.col("ids"), "n_pieces", "lossless")
