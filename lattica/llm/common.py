"""Shared folder, materialisation, size-checked broadcasts, bounded batches for Python and bounded label samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows times an estimated row width, that an operator broadcasts.
BROADCAST_BYTES = 48 << 20
#: Largest Arrow batch that a pipeline stage sends to a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        sc.setCheckpointDir(base)
    return (base or sc.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows times row_bytes stay under limit; otherwise df itself, for a shuffle join that adaptive execution splits where skewed."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES from here on; a lower setting stays.

    A batch stands in the executor (queued rows and Arrow buffers that double as they grow) and in its Python worker (bytes, strings and
    results) at once, for each task that runs. Spark's own bound of 64 MB lets a whole input split be one batch.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id, folds: int, fold: int):
    """True for rows that labels are never learned from: crc32(doc_id as text) mod folds = fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_sample(rows: DataFrame, label: str, per_label: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A repeatable sample of labelled rows: about per_label rows of every label, all of a label that has fewer.

    Rows are chosen by a 63-bit hash of `key` below a share that the label's count fixes, so no task sends more than its part and
    the expected size stays the same whatever the table's size. Rows that repeat the key stand or fall together.
    """
    n = rows.groupBy(label).count()
    share = written(n.select(F.col(label).alias("_l"), (F.lit(float(per_label)) / F.col("count")).alias("_t")), "label-shares")
    at = F.shiftrightunsigned(F.xxhash64(*key, F.lit("sample")), 1).cast("double") / float(1 << 63)
    return rows.join(small(share, 64), rows[label] == F.col("_l")).where(at < F.col("_t")).drop("_l", "_t")


def cut(text: Column, chars: int, pieces: int = 8) -> Column:
    """A text of at most about `chars` characters to learn from: the whole text, or evenly spaced pieces from its start to its end."""
    one = chars // pieces
    n = F.length(text)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (F.lit(1) + F.floor(i * (n - one) / (pieces - 1))).cast("int"), F.lit(one)))
    return F.when(n > chars, F.array_join(spaced, "\n")).otherwise(text)


def located(docs: DataFrame) -> DataFrame:
    """Rows of docs as a struct `row`, with file and at, which identify a stored row. Nothing of docs can clash with these names.

    Rows that come from no file are first written to the shared folder.
    """
    given = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row") if docs.columns else F.struct(F.lit(None).alias("none")).alias("row")
    try:
        meta = docs.metadataColumn("_metadata")
        out = docs.select(given, meta["file_path"].alias("file"), meta["row_index"].alias("at"))
        out.schema  # noqa: B018  analysis happens here
        return out
    except AnalysisException:  # a source without file metadata
        return located(written(docs, "rows"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The original rows of a located table without those that dropped (file, at) names."""
    return rows.join(small(written(dropped, "dropped"), 160), ["file", "at"], "left_anti").select("row.*")
