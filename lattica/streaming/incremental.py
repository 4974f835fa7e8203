"""Incremental index: new chunks from files as they arrive, each once, and their neighbours in all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import knn


def new_chunks(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of chunks from Parquet files of a folder; a chunk_id that was seen in any batch isn't given again."""
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(folder).dropDuplicates(["id"])


def run_index(spark: SparkSession, folder: str, index: str, checkpoint: str, k: int = 10, least: float = 0.3, files_per_batch: int | None = None, interval: str | None = None):
    """Feeds new chunks (id, vector) into the index folder: vectors, and edges of similarity at least `least` to the k nearest of old and new.

    A batch overwrites its own partition, so a repeated batch leaves no double. With an interval it goes on polling; else it ends when all is read.
    """
    stream = new_chunks(spark, folder, "id long, vector array<float>", files_per_batch)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{index}/vectors/batch={number}")
        new = session.read.parquet(f"{index}/vectors/batch={number}").select("id", "vector")
        known = session.read.option("basePath", f"{index}/vectors").parquet(f"{index}/vectors").where(F.col("batch") <= number).select("id", "vector")
        knn.search(new, known, k, least=least).write.mode("overwrite").parquet(f"{index}/edges/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, vector) and canonical edges (a, b, sim)."""
    return spark.read.parquet(f"{index}/vectors").select("id", "vector"), knn.canonical(spark.read.parquet(f"{index}/edges"))


def statistics(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("id").alias("last_id")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
