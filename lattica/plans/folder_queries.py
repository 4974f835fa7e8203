"""Folders and file lists, typed CSV, chunk and graph files, word lists, polling, plug-ins, layouts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.operators import extraction as ex
from lattica.operators import knn
from lattica.operators import pairs as pr
from lattica.plans.source_queries import _STREAM, _folder
from lattica.plans.vector_queries import _base
from lattica.sources import readers as rd
from lattica.sources.tables import table
from lattica.streaming import incremental as inc


def _text_folder(spark, sf_dir, path):
    """A file a supplier (text), a file a region (CSV of its nations), and files of an ending that nobody reads."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    s.select(F.concat_ws("\n", "s_name", F.col("s_nationkey").cast("string"))).write.option("maxRecordsPerFile", 1).text(f"{path}/texts")
    n.select("n_nationkey", F.concat("n_name", F.lit(', "a"\n'), "n_regionkey").alias("n_name"), "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").csv(f"{path}/tables", header=True, escape='"')
    n.write.mode("append").json(f"{path}/texts")


@query("""SELECT 'document' AS kind, count(*) AS n, sum(length(s_name) + 2 + length(s_nationkey::VARCHAR))::BIGINT AS chars FROM supplier UNION ALL
SELECT 'table', count(DISTINCT n_regionkey), sum(length(n_nationkey::VARCHAR) + 1 + length(n_name) + 12)::BIGINT + 19 * count(DISTINCT n_regionkey) FROM nation""")
def s1_folder_sources(spark, sf_dir):
    """Files of two folders by kind, with their lengths; a folder's other files and a missing folder aren't read."""
    path = _folder(spark, "folder")
    _text_folder(spark, sf_dir, path)
    regions = [f"{path}/tables/n_regionkey={r}" for r in range(5)]  # five regions at every scale
    found = rd.sources(spark, [f"{path}/texts", *regions, f"{path}/missing"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("SELECT s_suppkey, s_name AS title, s_nationkey::VARCHAR AS body FROM supplier")
def s2_listed_files(spark, sf_dir):
    """Text files named one by one, beside a name of nothing and files of another ending."""
    path = _folder(spark, "listed")
    s = table(spark, sf_dir, "supplier")
    s.select(F.concat_ws("\n", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))).write.option("maxRecordsPerFile", 1).text(path)
    s.select("s_name").write.mode("append").json(path)
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator()]
    found = rd.sources(spark, [*names, f"{path}/nothing.txt"])
    line = F.split(F.rtrim("content"), "\n")
    return found.select(line[0].cast("long").alias("s_suppkey"), line[1].alias("title"), line[2].alias("body"))


@query("""SELECT 'c_custkey' AS name, 'int' AS type, count(*) AS n FROM customer UNION ALL SELECT 'c_name', 'string', count(*) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(*) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'ts', 'timestamp', count(*) FROM events UNION ALL SELECT 'event_type', 'string', count(*) FROM events""")
def s7_typed_csv(spark, sf_dir):
    """Columns of CSV files with their inferred types and values that aren't null; files of two headers in one folder, names over two lines."""
    path = _folder(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(',\n"'), "c_mktsegment").alias("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    c.write.csv(path, header=True, escape='"')
    table(spark, sf_dir, "events").select("ts", "event_type").write.mode("append").csv(path, header=True)
    parts = []
    for rows in rd.csv_tables(spark, [path]).values():
        kinds = [(x, t) for x, t in rows.dtypes if x != "path"]
        counts = rows.agg(*[F.count(x).alias(x) for x, _ in kinds])
        parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.lit(t).alias("type"), F.col(x).alias("n")) for x, t in kinds]))))
    return rd.union_all(parts)


_CHUNK = "chunk_id string, content string, sentences array<string>, source_name string"


@query("""SELECT 's'||s_suppkey AS chunk_id, 'document' AS kind, s_name AS content, 2 AS n_sentences FROM supplier WHERE s_acctbal > 0 UNION ALL
SELECT 'n'||n_nationkey, 'table', n_name, 0 FROM nation WHERE n_regionkey = 1""")
def s8_chunk_files(spark, sf_dir):
    """Document chunks from a file each and table chunks from one array, those of an allow-list; a broken file between them."""
    path = _folder(spark, "chunks")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    chunk = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("chunk_id"), F.col("s_name").alias("content"), F.array("s_name", F.lit("End.")).alias("sentences"))
    chunk.write.option("maxRecordsPerFile", 1).json(f"{path}/documents")
    spark.createDataFrame([('{"chunk_id": ',)], "value string").write.text(f"{path}/broken")
    array = n.groupBy().agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey")).alias("chunk_id"), F.col("n_name").alias("content"))).alias("l"))  # 25 nations at every scale
    array.select(F.to_json("l")).write.text(f"{path}/tables")
    found = rd.union_all([rd.chunk_files(spark, f"{path}/{f}", _CHUNK, "*.{json,txt}").withColumn("kind", F.lit(kind)) for f, kind in (("documents", "document"), ("broken", "document"), ("tables", "table"))])
    ids = s.where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("chunk_id")).unionByName(n.where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("chunk_id")))
    return rd.allowed(found, ids).select("chunk_id", "kind", "content", F.coalesce(F.size("sentences"), F.lit(0)).alias("n_sentences"))


@query("""SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'a||c' WHEN 1 THEN 'x|y' ELSE '' END AS descriptions, CASE WHEN label % 2 = 0 THEN '' ELSE 'short' END AS content FROM embeddings""")
def s16_graph_import(spark, sf_dir):
    """Nodes whose column descriptions were an object, a list or neither, and whose content was empty; a malformed line between them."""
    path = _folder(spark, "import")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    raw = F.when(F.col("id") % 3 == 0, F.lit('{"z":"c","x":"a"}')).when(F.col("id") % 3 == 1, F.lit('["x","y"]')).otherwise(F.lit("7"))
    kind = F.when(F.col("label") % 2 == 0, "document").otherwise("table")
    line = F.format_string('{"id":%d,"kind":"%s","content":"","summary":"short","column_headers":["x","y","z"],"column_descriptions":%s}', F.col("id"), kind, raw)
    v.select(line.alias("value")).unionByName(spark.createDataFrame([('{"id": 1, "kind',)], "value string")).write.text(f"{path}/nodes")
    spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")).write.json(f"{path}/edges")
    nodes, _ = rd.read_graph(spark, path)
    return nodes.select("id", F.array_join("column_descriptions", "|").alias("descriptions"), "content")


@query("SELECT lang AS language, count(DISTINCT w) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang IS NOT NULL) WHERE length(w) <= 3 GROUP BY 1")
def s30_word_files(spark, sf_dir):
    """Word lists of the languages' short words, written as files, read again and counted; blank lines and repeats fall away."""
    path = _folder(spark, "words")
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("language"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    short = d.where(F.length("word") <= 3).distinct()
    lines = short.select("language", F.explode(F.array("word", F.lit(""), F.concat(F.lit(" "), "word"))).alias("word"))
    lines.write.partitionBy("language").text(path)
    return rd.word_files(spark, path).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STREAM.replace('vec_id % 3', 'vec_id % 2')} SELECT (SELECT count(*) FROM e) AS n_vectors, (SELECT max(id) FROM e) AS last_id, count(*) AS n_edges FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM n WHERE sim >= 0.3)")
def t1_polled_index(spark, sf_dir):
    """An index that polls its folder every second while a second arrival comes in."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    arrivals, index, checkpoint = (_folder(spark, x) for x in ("arrivals", "index", "state"))
    v.where("id % 2 = 0").write.parquet(arrivals)
    run = inc.run_index(spark, arrivals, index, checkpoint, interval="1 second")
    try:
        run.processAllAvailable()
        v.where("id % 2 = 1").write.mode("append").parquet(arrivals)
        run.processAllAvailable()
    finally:
        run.stop()
    return inc.statistics(*inc.read_index(spark, index))


@query("SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id")
def e3_similarity_rows(spark, sf_dir):
    """Rows of the cosine matrix, in blocks: those of the stated query set, against all vectors."""
    v = _base(spark, sf_dir).select("id", "vector")
    return knn.near(v.where("id % 100 = 0"), v, least=-2.0).select("src", "dst", F.round("sim", 6).alias("sim"))


@query("""WITH n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, string_split(text, ' ') AS cells FROM benchmark)
SELECT doc_id, item_id, array_to_string(list_filter(cells, lambda v: length(v) > 2 AND contains(lower(text), lower(v)))[1:10], ',') AS refs FROM documents, n JOIN i ON i.i = doc_id % n""")
def j15_references_in_texts(spark, sf_dir):
    """Cells of a table's row (an item's words) that the text of the document beside it holds; each document has one row of the table beside it."""
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    rows = b.select("item_id", (F.row_number().over(W.orderBy("item_id")) - 1).cast("long").alias("i"), F.split("text", " ").alias("cells"))  # the benchmark is a small table
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("i"))
    return d.join(rows, "i").select("doc_id", "item_id", F.array_join(pr.references(F.col("cells"), F.col("text")), ",").alias("refs"))


@query("""SELECT doc_id, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS x)) AS entities,
(SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:1[0-9]|20)[0-9][0-9]')) AS x)) AS events, 0 AS n_failed FROM documents""")
def q8_extracted_facts(spark, sf_dir):
    """Entities and events of every text by the default extractor, and by one that fails."""

    def failing():
        raise_ = {}
        return lambda texts: raise_["no model"]

    d = ex.extracted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    d = ex.extracted(d.withColumnsRenamed({"entities": "e", "events": "v"}), "text", failing)
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), "|"))
    return d.select("doc_id", listed("e").alias("entities"), listed("v").alias("events"), (F.size("entities") + F.size("events")).alias("n_failed"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, 2 AS attempts FROM customer GROUP BY 1")
def q6_generated_query(spark, sf_dir):
    """A query that a generator wrote; its first one names a column that isn't there, the second follows from the error."""

    def generate(question: str, error: str | None) -> str:
        column = "segment" if error is None else "c_mktsegment"
        return f"SELECT {column} AS segment, count(*) AS n FROM {{customer}} GROUP BY 1"

    rows, attempts = ex.generated(spark, "customers by segment", generate, {"customer": table(spark, sf_dir, "customer")})
    return rows.withColumn("attempts", F.lit(attempts))


@query("""SELECT vec_id AS id, round((1 + label) * cos(2 * pi() * i / n), 6) AS shell_x, round((1 + label) * sin(2 * pi() * i / n), 6) AS shell_y, round(('0x'||substr(md5(vec_id||':x'), 1, 8))::BIGINT / 4294967296, 6) AS random_x, round(('0x'||substr(md5(vec_id||':y'), 1, 8))::BIGINT / 4294967296, 6) AS random_y
FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def g12_layouts(spark, sf_dir):
    """Coordinates on a circle a label, and seeded random ones."""
    w = W.partitionBy("label")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    turn = 2 * F.pi() * (F.row_number().over(w.orderBy("id")) - 1) / F.count(F.lit(1)).over(w)
    seeded = lambda axis: F.round(F.conv(F.substring(F.md5(F.concat("id", F.lit(f":{axis}")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296, 6).alias(f"random_{axis}")
    return v.withColumn("_t", turn).select("id", F.round((1 + F.col("label")) * F.cos("_t"), 6).alias("shell_x"), F.round((1 + F.col("label")) * F.sin("_t"), 6).alias("shell_y"), seeded("x"), seeded("y"))
