"""The corpus pipeline: quality filter, exact dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import stages
from lattica.llm.common import table, written
from lattica.session import ship

#: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next stage's docs.
STAGES = [
    ("quality_classifier", stages.quality),
    ("exact_dedup", stages.exact),
    ("simhash_near_dedup", stages.near),
    ("benchmark_decontamination", stages.decontaminate),
    ("best_fit_packing", stages.pack),
]

#: The quality classifier can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
