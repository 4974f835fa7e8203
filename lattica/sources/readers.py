"""Readers and writers: text and table folders, JSON metadata and chunk files, graph files, ranked lists, node and edge dumps."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds by file ending, tokens that stand for no value, names of the list under which entries may be, ordinals.
DOCUMENT_ENDINGS, TABLE_ENDINGS = ("txt", "md", "pdf", "docx", "html"), ("csv", "tsv", "xlsx", "xls", "parquet")
TEXT_ENDINGS, CSV_ENDING = ("txt",), "csv"
NULL_TOKENS = ("nan", "none", "null")
ENTRY_KEYS = ("data", "items", "entries")
RANKS = 100


def text_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.txt") -> DataFrame:
    """path, content of whole files; the folder isn't searched deeper."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths at which there is something."""
    conf = spark._jsc.hadoopConfiguration()
    found = [(p, spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, x in found if x.getFileSystem(conf).exists(x)]


def sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, kind, content of the text files and CSV files among the paths, or in folders among them; what is missing, empty or of another ending is left out."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "path string, name string, kind string, content string")
    files = text_files(spark, there, "*.{" + ",".join(e for x in (*TEXT_ENDINGS, CSV_ENDING) for e in (x, x.upper())) + "}")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.when(ending == CSV_ENDING, "table").otherwise("document").alias("kind"), "content")


def csv_tables(spark: SparkSession, paths: list[str], pattern: str = "*.csv") -> dict[str, DataFrame]:
    """header line -> rows of all CSV files that begin with it, their columns with inferred types and path; values in quotes may hold line breaks.

    Missing paths and files without a line are left out. A line that doesn't fit its header gives nulls or loses what is too much. The
    driver holds one plan a distinct header and the list of files, as Spark's own file index does.
    """
    there = existing(spark, paths)
    if not there:
        return {}
    lines = spark.read.option("pathGlobFilter", pattern).text(there).where("_metadata.file_block_start = 0")
    placed = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    firsts = placed.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    found: dict[str, list[str]] = {}
    for path, header in firsts.orderBy("path").toLocalIterator():
        if header.strip():
            found.setdefault(header.rstrip("\r"), []).append(unquote(path))
    read = spark.read.options(header=True, inferSchema=True, multiLine=True, quote='"', escape='"')
    return {header: read.csv(files).withColumn("path", F.col("_metadata.file_path")) for header, files in found.items()}


def table_rows(spark: SparkSession, paths: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """path, rn, row (column name -> value as text) of CSV files with headers; each file keeps its own columns, rn follows a file's rows."""
    parts = []
    for rows in csv_tables(spark, [paths] if isinstance(paths, str) else paths, pattern).values():
        cells = F.create_map(*[x for c in rows.columns if c != "path" for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
        parts.append(rows.select("path", F.monotonically_increasing_id().alias("rn"), cells.alias("row")))
    return union_all(parts) if parts else spark.createDataFrame([], "path string, rn long, row map<string,string>")


def chunk_files(spark: SparkSession, paths: str | list[str], schema: str, pattern: str = "*.json") -> DataFrame:
    """Chunks of JSON files, one chunk or one array of chunks a file; malformed files and chunks without chunk_id are left out."""
    rows = spark.read.schema(schema).options(multiLine=True, mode="DROPMALFORMED", pathGlobFilter=pattern).json(paths)
    return rows.where("chunk_id IS NOT NULL")


def column_descriptions(raw: Column, headers: Column) -> Column:
    """Descriptions as a list: a JSON object gives one of each header ('' where it has none), a JSON list stays, anything else is an empty list."""
    none, text = F.array().cast("array<string>"), F.trim(raw)
    named = F.from_json(text, "map<string,string>")
    by_header = F.transform(F.coalesce(headers, none), lambda h: F.coalesce(F.try_element_at(named, h), F.lit("")))
    return F.when(F.startswith(text, F.lit("{")), by_header).when(F.startswith(text, F.lit("[")), F.coalesce(F.from_json(text, "array<string>"), none)).otherwise(none)


def word_files(spark: SparkSession, folder: str) -> DataFrame:
    """language, word of a folder of word lists, one file or folder a language and a word a line; blank lines count for nothing."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).withColumn("path", F.url_decode(F.col("_metadata.file_path")))
    language = F.regexp_extract("path", "/language=([^/]+)/", 1)
    named = F.when(language != "", language).otherwise(F.regexp_extract("path", r"/([^/]+?)(\.[^./]*)?$", 1))
    return lines.select(named.alias("language"), F.trim("value").alias("word")).where("word <> ''").distinct()


def by_ending(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin(*DOCUMENT_ENDINGS), "document").when(ending.isin(*TABLE_ENDINGS), "table")


def kind_of(source_type: Column, path: Column) -> Column:
    """The named type if it is one or holds its name, else by the file's ending."""
    low = F.lower(F.coalesce(source_type, F.lit("")))
    return F.when(F.contains(low, F.lit("document")), "document").when(F.contains(low, F.lit("table")), "table").otherwise(by_ending(F.coalesce(path, F.lit(""))))


def metadata(entries: DataFrame, source_type: str, start: int | None = None, end: int | None = None, order: str = "id") -> DataFrame:
    """Entries of a type, from `start` to before `end` in their order."""
    rows = entries.where(F.col("source_type") == source_type)
    if start is None and end is None:
        return rows
    ranked = rows.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1)
    cond = (F.col("_i") >= (start or 0)) & (F.lit(True) if end is None else F.col("_i") < end)
    return ranked.where(cond).drop("_i")


def json_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, content of entries in JSON files: a list, or an object with content, data, items or entries; malformed files are skipped."""
    fields = "struct<id:string,title:string,file_path:string,content:string,text:string>"
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    listed = F.from_json("value", f"array<{fields}>")
    keyed = F.from_json("value", f"struct<content:array<{fields}>,{','.join(f'{k}:array<{fields}>' for k in ENTRY_KEYS)}>")
    is_list = F.col("value").rlike(r"^\s*\[")
    found = F.when(is_list, listed).otherwise(F.coalesce(keyed["content"], *[keyed[k] for k in ENTRY_KEYS]))
    rows = raw.select("path", F.posexplode(found).alias("i", "e"))
    source = F.coalesce("e.id", "e.title", "e.file_path", F.concat(F.lit("item_"), F.col("i").cast("string")))
    return rows.select("path", "i", source.alias("source"), F.coalesce("e.content", "e.text").alias("content")).where("content IS NOT NULL")


def allowed(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def local_ids(nodes: DataFrame, kind: str = "type", order: str = "node_index") -> DataFrame:
    """nodes with local_id: a dense number from 0 within each type."""
    return nodes.withColumn("local_id", F.row_number().over(W.partitionBy(kind).orderBy(order)).cast("long") - 1)


def edge_arrays(dump: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, relation from parallel arrays (edge_index of two arrays, edge_types) and a code table (code, name src___relation___dst); edges with unknown ends are dropped."""
    zipped = dump.select(F.inline(F.arrays_zip(F.col("edge_index")[0].alias("src"), F.col("edge_index")[1].alias("dst"), F.col("edge_types").alias("code"))))
    named = zipped.join(F.broadcast(names), "code").withColumn("relation", F.split_part(F.col("name"), F.lit("___"), F.lit(2)))
    ids = nodes.select("id").distinct()
    return named.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")


def filled(*columns: str) -> Column:
    """Values that say something, joined by blanks in the given order."""
    kept = [F.when(~F.lower(F.trim(c)).isin("", *NULL_TOKENS), F.trim(c)) for c in columns]
    return F.concat_ws(" ", *kept)


def ordinal(i: int) -> str:
    return {1: "1st", 2: "2nd", 3: "3rd"}.get(i, f"{i}th")


def wide_list(df: DataFrame, k: int) -> Column:
    """The first k values of the ordinal columns that there are (at most RANKS), nulls left out."""
    names = [ordinal(i) for i in range(1, min(k, RANKS) + 1) if ordinal(i) in df.columns]
    return F.slice(F.filter(F.array(*[F.col(f"`{n}`").cast("string") for n in names]), lambda x: x.isNotNull()), 1, k)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and those edges that have both ends among them; malformed lines are skipped.

    Empty table content falls back to its summary, column descriptions become a list, a missing edge type is doc-doc.
    """
    nodes = spark.read.schema("id long, kind string, content string, summary string, column_headers array<string>, column_descriptions string").option("mode", "DROPMALFORMED").json(f"{path}/nodes").where("id IS NOT NULL")
    edges = spark.read.schema("src long, dst long, edge_type string, similarity double").option("mode", "DROPMALFORMED").json(f"{path}/edges")
    nodes = nodes.withColumn("content", F.when(F.col("kind") == "table", F.coalesce(F.nullif("content", F.lit("")), "summary")).otherwise(F.col("content")))
    nodes = nodes.withColumn("column_descriptions", column_descriptions(F.col("column_descriptions"), F.col("column_headers")))
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept.withColumn("edge_type", F.coalesce("edge_type", F.lit("doc-doc")))


def write_batch(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch:06d}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def search_names(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Nodes whose name holds the given one, ignoring case."""
    hit = F.contains(F.lower("name"), F.lit(name.lower()))
    return nodes.where(hit if kind is None else hit & (F.col("type") == kind))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
