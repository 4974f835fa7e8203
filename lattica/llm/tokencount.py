"""Token counts by a separator scan over flat, unindexed token files.

The writer turns texts into files of little-endian 16- or 32-bit ids with an end-of-document id after each. The counter knows
nothing but these files: it cuts them into blocks of equal size, finds the end-of-document ids of a block by one vectorised
comparison, and stitches documents across blocks by a prefix scan over the blocks of a file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written
from .files import Committed, opened

#: Parameters: vocabulary file (token in base64, rank), its splitting pattern and end-of-document id; tokens of a block; bytes at which a file ends.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, BLOCK_TOKENS, ROLL_BYTES = 50256, 1 << 20, 64 << 20
#: Runs of the pattern's white space that are encoded apart.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def id_type(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A function from text to ids. Long runs of white space, on which the pattern's look-ahead would exhaust the matcher's stack, are
    cut out first at the places where the pattern cuts them: all but the last character of a run are one piece, and the last one
    goes with what follows (the whole run is one piece at the end of a text)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    inner = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if LONG_BLANK.search(text) is None:
            return inner.encode_ordinary(text)
        ids, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            ids += inner.encode_ordinary(text[at : m.start()])
            ids += inner._encode_single_piece(text[m.start() : end])
            at = end
        return ids + inner.encode_ordinary(text[at:])

    return encode


def _writer(folder: str, vocabulary, pattern: str, end: int, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, kind, part = encoder(vocabulary.value, pattern), id_type(end), TaskContext.get().partitionId()
        out, n_file, nth = None, 0, 0
        for pdf in batches:
            listed = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if out is None:
                    out, nth = Committed(folder, f"tokens-{part:06d}-{n_file:05d}.bin"), 0
                ids = encode(text.encode("utf-8", "replace").decode()) if isinstance(text, str) else []
                out.write(np.array([*ids, end], kind).tobytes())
                listed.append((doc_id, out.final.rsplit("/", 1)[1], nth))
                nth += 1
                if out.size >= roll:
                    out.commit()
                    out, n_file = None, n_file + 1
            yield pd.DataFrame(listed, columns=["doc_id", "file", "nth"]).astype({"doc_id": "Int64"})
        if out is not None:
            out.commit()

    return write


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes one or more token files for each partition; returns the order of documents: doc_id, file, nth. Null text has no tokens."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    order = docs.select("doc_id", "text").mapInPandas(_writer(folder, shared, pattern, end, roll_bytes), "doc_id long, file string, nth long")
    order.write.parquet(f"{folder}/_order")
    return spark.read.parquet(f"{folder}/_order")


def _scanner(folder: str, end: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        kind = id_type(end)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                with fs.open_input_file(f"{root}/{r.file}") as f:
                    ids = np.frombuffer(f.read_at(int(r.length) * kind.itemsize, int(r.first) * kind.itemsize), kind)
                ends = np.flatnonzero(ids == end).astype(np.int64) + int(r.first)
                yield pd.DataFrame({"file": r.file, "block": r.block, "n": np.int64(len(ends)), "last": pd.array([ends[-1] if len(ends) else None], "Int64"), "ends": [ends]})

    return scan


def count(spark: SparkSession, folder: str, files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat files (file, n_tokens with separators): file, nth, start, n_tokens. Tokens after a file's last separator are a document of their own.

    The files are scanned once, into a table of the blocks' separators. The prefix scan runs over one small row for each block.
    """
    blocks = files.where("n_tokens > 0").select("file", F.col("n_tokens").alias("size"), F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {block_tokens})")).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block_tokens).alias("first"), F.least(F.lit(block_tokens).cast("long"), F.col("size") - F.col("block") * block_tokens).alias("length"))
    n = max(1, min(20_000, blocks.count() // 4 + 1))
    found = written(blocks.repartition(n).mapInPandas(_scanner(folder, end), "file string, block long, n long, last long, ends array<long>"), "token-ends")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    small_rows = found.select("file", "block", "n", "last")
    stitched = small_rows.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nth0"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    each = found.where("n > 0").select("file", "block", "ends").join(stitched, ["file", "block"]).select("file", "nth0", "open", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("ends[i - 1]")) + 1
    closed = each.select("file", (F.col("nth0") + F.col("i")).alias("nth"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))
    last = small_rows.groupBy("file").agg(F.max("last").alias("at"), F.sum("n").alias("nth")).join(files, "file")
    start = F.coalesce(F.col("at"), F.lit(-1)) + 1
    rest = last.where(start < F.col("n_tokens")).select("file", "nth", start.alias("start"), (F.col("n_tokens") - start).alias("n_tokens"))
    return closed.unionByName(rest)


def listed(spark: SparkSession, folder: str, end: int = END) -> DataFrame:
    """Token files of a folder with their sizes in tokens, from the folder's listing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for s in fs.listStatus(hadoop.Path(folder)) if fs.exists(hadoop.Path(folder)) else []:
        name = s.getPath().getName()
        if name.endswith(".bin") and not name.startswith("."):
            rows.append((name, s.getLen() // id_type(end).itemsize))
    return spark.createDataFrame(rows, "file string, n_tokens long")


def counted(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, file, nth, start of each row of docs: writes the token files, then counts them by scan.

    Null and empty texts have no tokens; texts of any length are encoded whole. Repeated rows, and rows that tie in doc_id, are
    documents of their own. An empty table gives no file and no row. Columns other than doc_id and text aren't read, whatever their
    names. Both sides of the join grow with the documents, so it is always a sort-merge join.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    order = write(docs, folder, vocabulary)
    return order.hint("merge").join(count(spark, folder, listed(spark, folder)), ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth", "start")
