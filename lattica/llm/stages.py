"""Stages of the corpus pipeline: functions of (spark, docs, sf_dir). All but the last return the columns of docs. Those that run Python bound the session's Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate as decontamination
from . import exact_dedup, packing, simhash
from . import quality as quality_model
from .common import bounded_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    bounded_batches(spark)
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    bounded_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of what is left."""
    bounded_batches(spark)
    return packing.packed(docs)
