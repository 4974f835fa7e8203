"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page_id into shards whose bounds come from a hash sample of the rows' content, so the same rows give the
same files whatever the cluster and the layout of the input. Each shard rolls its files by compressed size. Headers and digests are made anew. A file is written
under a temporary name and then renamed; the manifest, itself written aside and renamed, lists the files that count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, scratch, small, written
from .files import Committed, opened

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Least payload, in bytes, that is stored as a revisit; parameters: payload of a shard, shards at most (larger ones beyond, each
#: rolled into files as it is written), compressed size at which a file ends, sample rows for each shard and in all.
REVISIT_BYTES, SHARD_BYTES, MAX_SHARDS, ROLL_BYTES, SAMPLE_PER_SHARD, SAMPLE_ROWS = 1000, 32 << 20, 20_000, 16 << 20, 200, 400_000
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string, file string"


def record_id(kind: str, page_id, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{page_id}:{digest}:{nth}')}>"


def _one_line(s: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in (s or ""))


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, revisit: bool, nth: int) -> bytes:
    """One gzip member. A revisit has the HTTP header alone; its Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (b"" if revisit else payload)
    b32 = lambda d: base64.b32encode(d).decode()
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id("revisit" if revisit else "response", page_id, digest, nth), "WARC-Date": DATE, "WARC-Target-URI": _one_line(url) or f"urn:page:{page_id}",
        "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": "sha1:" + b32(bytes.fromhex(digest)), "WARC-Block-Digest": "sha1:" + b32(hashlib.sha1(block).digest()),
    }
    if url is None:
        head["X-No-URL"] = "1"
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", refers_to, digest)}
        if refers_to is not None:
            head["X-Refers-To-Page-ID"] = str(refers_to)
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, n_file, out, rows, last, nth, listed = None, 0, None, 0, None, 0, []

        def close():
            out.commit()
            listed.append((out.final.rsplit("/", 1)[1], shard, n_file, rows, out.size))

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is not None and (r.shard != shard or out.size >= roll):
                    close()
                    n_file = n_file + 1 if r.shard == shard else 0
                    out = None
                elif out is None:
                    n_file = 0
                if r.shard != shard:
                    shard, last = r.shard, None
                if out is None:
                    out, rows = Committed(folder, f"part-{shard:06d}-{n_file:05d}.warc.gz"), 0
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                nth = nth + 1 if last == (page_id, r.digest) else 0
                last = (page_id, r.digest)
                payload = b"" if r.payload is None else r.payload.encode("utf-8", "surrogatepass")
                out.write(record(page_id, r.url, payload, r.digest, int(r.payload_bytes), refers, bool(r.revisit), nth))
                rows += 1
        if out is not None:
            close()
        yield pd.DataFrame(listed, columns=["file", "shard", "nth", "n_records", "n_bytes"])

    return write


def _sharder(bounds: list[tuple[int, int]]):
    """Shard of (key, tie): the number of bounds at or below it, found by binary search over whole batches."""
    keys, ties = np.array([k for k, _ in bounds], np.int64), np.array([t for _, t in bounds], np.int64)

    @F.pandas_udf("int")
    def shard(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        for i in np.flatnonzero(high > low):  # only rows that share a bound's key
            low[i] += np.searchsorted(ties[low[i] : high[i]], t[i], side="right")
        return pd.Series(low, dtype="int32")

    return shard


def plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One row per page with its digest, size and part: revisit, refers_to.

    Of equal payloads of at least `least` bytes the row with the largest page_id is the response (a null page_id is the least); of
    repeated ids that with the largest url, of rows that are all equal the last stored.
    """
    payload = F.coalesce(F.col("row.html"), F.lit(""))
    rows = located(pages.select("page_id", "url", "html")).select("row.page_id", "row.url", "file", "at", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("digest"), F.xxhash64(payload).alias("also"))
    key = ["digest", "also", "payload_bytes"]
    equal = rows.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.max(F.struct("page_id", "url", "file", "at")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "best")
    marked = rows.join(small(written(equal, "equal"), 250), key, "left")
    revisit = F.coalesce((F.col("best.file") != F.col("file")) | (F.col("best.at") != F.col("at")), F.lit(False))
    return marked.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("best.page_id")), "payload": F.when(~revisit, F.col("payload"))}).drop("best", "also")


def _order():
    """Sort key of a record, and a tie of its content alone, so that the place of a row in the input doesn't matter."""
    return F.coalesce("page_id", F.lit(-(1 << 63))), F.xxhash64("page_id", "url", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))


def bounds_of(pages: DataFrame, n_shards: int, n_rows: int) -> list[tuple[int, int]]:
    """Up to n_shards - 1 bounds (key, tie) that cut the payload bytes about evenly, from a hash sample of at most about SAMPLE_ROWS rows."""
    if n_shards < 2:
        return []
    k, t = _order()
    keys = pages.select(k.alias("k"), t.alias("t"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 500).alias("w"))
    share = min(1.0, min(SAMPLE_PER_SHARD * n_shards, SAMPLE_ROWS) / max(n_rows, 1))
    picked = keys.where(F.shiftrightunsigned(F.xxhash64("k", "t"), 1).cast("double") / float(1 << 63) < share)
    sample = sorted((r.k, r.t, r.w) for r in picked.dropDuplicates(["k", "t"]).collect())
    total = np.cumsum([w for *_, w in sample]) if sample else np.zeros(0)
    if not len(total):
        return []
    at = np.searchsorted(total, total[-1] * np.arange(1, n_shards) / n_shards)
    return [sample[i][:2] for i in sorted(set(at.tolist()))]


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives and returns the manifest: file, shard, nth, n_records, n_bytes.

    Null html is an empty payload, a null url a urn; a null page_id sorts first and has no id header. Repeated rows are records of
    their own, numbered in their ids. Payloads of any length are one record, streamed one at a time. An empty table writes an empty
    manifest and no archive. Columns other than page_id, url and html aren't read, whatever their names.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    size = pages.agg(F.sum(F.octet_length("html")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bounds = bounds_of(pages, min(MAX_SHARDS, math.ceil((size.b or 0) / shard_bytes)), size.n)
    order, _ = _order()
    # the payload of a revisit is gone by now; its digest tells as much
    keyed = plan(pages).withColumns({"key": order, "tie": F.xxhash64("page_id", "url", "digest")})
    n = len(bounds) + 1
    placed = keyed.withColumn("shard", _sharder(bounds)("key", "tie")).repartitionById(n, "shard").sortWithinPartitions("shard", "key", "tie", "digest", "revisit")
    listed = placed.select("shard", "page_id", "url", "payload", "payload_bytes", "digest", "revisit", "refers_to").mapInPandas(_writer(folder, roll_bytes), "file string, shard int, nth int, n_records long, n_bytes long")
    listed.write.parquet(f"{folder}/_manifest.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hadoop.Path(f"{folder}/_manifest.tmp"), hadoop.Path(f"{folder}/_manifest")):
        raise OSError(f"the manifest of {folder} is there already")
    return spark.read.parquet(f"{folder}/_manifest")


def _head(data: bytes) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x), end + 4


def parsed(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload); digests and lengths are checked."""
    head, at = _head(member)
    block = member[at : at + int(head["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {head['WARC-Record-ID']}")
    http, body = _head(block)
    payload, size = block[body:], int(http["Content-Length"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = head["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload differs in {head['WARC-Record-ID']}")
    number = lambda k: int(head[k]) if k in head else None
    url = None if "X-No-URL" in head else head["WARC-Target-URI"]
    return number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), url, payload.decode("utf-8", "surrogatepass") if response else None


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        for pdf in batches:
            for name in pdf["file"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows, used = [], 0
                for m in members(data):
                    *r, payload = parsed(m)
                    rows.append((*r, payload if with_payload else None, name))
                    used += len(m)
                    if used >= 8 << 20:
                        yield _frame(rows)
                        rows, used = [], 0
                if rows:
                    yield _frame(rows)

    return read


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out, step = zlib.decompressobj(31), [], at
        while not z.eof:
            if step >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = view[step : step + 65536]
            out.append(z.decompress(piece))
            step += len(piece)
        yield b"".join(out)
        at = step - len(z.unused_data)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "file"], dtype=object)
    return f.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists."""
    files = spark.read.parquet(f"{folder}/_manifest").select("file")
    n = max(1, min(files.count(), MAX_SHARDS))
    return files.repartition(n).mapInPandas(_reader(folder, with_payload), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives and reads their records back, without payloads; edge cases as in write()."""
    folder = folder or scratch(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder, with_payload=False)
