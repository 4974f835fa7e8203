"""Exact deduplication by stateful streaming, on DataFrame operations only.

An arrival log (digest, identifier, length, content locator) is read as a stream into an aggregation whose state lives in
RocksDB, keyed by digest, without watermark or expiry. The state keeps the stable identifier and the locator of the row that
stays. Digests with more than one row are hits: their full normalised texts are compared byte by byte (the least and the
greatest text of a digest are equal exactly if all are), and rows whose digest collides are grouped by text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, located, scratch, small, without

#: The characters that equality ignores.
IGNORED = " \t\n\x0b\x0c\r"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # preallocated files would take about 3 MB for each store
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Parameter: files of the arrival log in a micro-batch; the state carries over from one to the next.
FILES_PER_BATCH = 1000
#: On file:// paths, where the default manager starts a chmod process for each file.
LOCAL_FILES = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def arrivals(rows: DataFrame, digest) -> DataFrame:
    return rows.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), (-F.length(F.coalesce("text", F.lit("")))).alias("neg_chars"), "file", "at")


def best_row() -> Column:
    """The row that stays: most code points, then least doc_id (null last), then storage order."""
    return F.min(F.struct("neg_chars", F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at"))


def stream_state(spark: SparkSession, log: str, checkpoint: str, out: str, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Feeds the log's files through the keyed state and returns its last value for each digest. A restart with the same checkpoint resumes."""
    own = spark.newSession()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")  # a new session starts from the application's settings
    for k, v in (ROCKSDB | (LOCAL_FILES if checkpoint.startswith(("file:", "/")) else {}) | {"spark.sql.shuffle.partitions": partitions}).items():
        own.conf.set(k, v)
    source = own.readStream.schema(spark.read.parquet(log).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = source.parquet(log).groupBy("digest").agg(best_row().alias("best"), F.count(F.lit(1)).alias("n"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b{batch}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    id_type = dict(spark.read.parquet(log).dtypes)["doc_id"]
    schema = f"digest string, best struct<neg_chars int, no_id boolean, doc_id {id_type}, file string, at long>, n long, batch int"
    done = [p["batchId"] for p in query.recentProgress]
    last = spark.read.schema(schema).parquet(f"{out}/*") if done else spark.createDataFrame([], schema)
    if max(done, default=0) > 0:  # a single batch has every digest once
        last = last.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.*")
    return last.select("digest", "best", "n")


def classes(docs: DataFrame, digest=sha256, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """One row per row of docs: doc_id, file, at, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null text counts as empty, so null, empty and blank texts are one group. Of rows that tie in length and doc_id (repeated rows)
    the first stored one stays; a null doc_id comes after all others. Texts of any length are compared whole; the keyed state holds
    their digests only. An empty table gives an empty table. Columns other than doc_id and text aren't read, whatever their names.
    digest is a parameter so that tests can make it collide.
    """
    return _classes(located(docs), digest, files_per_batch)


def _classes(located_rows: DataFrame, digest=sha256, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    spark = located_rows.sparkSession
    log, checkpoint, out = (scratch(spark, f"dedup-{x}") for x in ("log", "state", "out"))
    rows = located_rows.select("row.doc_id", "row.text", "file", "at")
    arrivals(rows, digest).write.parquet(log)
    state = stream_state(spark, log, checkpoint, out, files_per_batch)
    drop_path(spark, checkpoint)
    hits = small(state.where("n > 1").select("digest", "best", "n"), 300)
    texts = rows.select("doc_id", "file", "at", normalised(F.col("text")).alias("norm"), (-F.length(F.coalesce("text", F.lit("")))).alias("neg_chars")).withColumn("digest", digest(F.col("norm")))
    checked = texts.join(hits.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    differ_path = scratch(spark, "dedup-differ")
    checked.where("least <> most").select("digest").write.parquet(differ_path)
    differ = spark.read.schema("digest string").parquet(differ_path)
    logged = spark.read.parquet(log)
    joined = logged.join(hits, "digest", "left")
    if not differ.isEmpty():
        by_text = texts.join(differ, "digest", "left_semi").groupBy("digest", "norm").agg(best_row().alias("tbest"), F.count(F.lit(1)).alias("tn"))
        each = texts.join(differ, "digest", "left_semi").select("digest", "norm", "file", "at").join(by_text, ["digest", "norm"]).select("file", "at", "tbest", "tn", sha256(F.col("norm")).alias("tsha"))
        joined = joined.join(each, ["file", "at"], "left").withColumns({"best": F.coalesce("tbest", "best"), "n": F.coalesce("tn", "n")})
    if digest is not sha256:
        joined = joined.join(texts.select("file", "at", sha256(F.col("norm")).alias("text_sha256")), ["file", "at"])
    else:
        joined = joined.withColumn("text_sha256", F.col("digest"))
    own = F.col("best").isNull()
    kept = own | ((F.col("best.file") == F.col("file")) & (F.col("best.at") == F.col("at")))
    return joined.select(
        "doc_id", "file", "at", F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that equal another one that stays; columns as given."""
    rows = located(docs)
    return without(rows, _classes(rows).where(~F.col("kept")).select("file", "at"))
