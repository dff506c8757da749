"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and returns the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafstrata.llm import stages
from leafstrata.llm.common import materialise, table

STAGES = [
    ("quality_classifier", stages.quality),
    ("exact_dedup", stages.exact),
    ("simhash_near_dedup", stages.near),
    ("poisson_mixing", stages.mixing_stage),
    ("sentencepiece", stages.encode),
]

#: A boosted classifier, fingerprints and a tokenizer are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the table documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
