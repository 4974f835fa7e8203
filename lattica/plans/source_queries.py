"""Readers, keyed tables and incremental input."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import vectors as vx
from lattica.operators import graph as g
from lattica.operators import traversal as tr
from lattica.sources import readers as rd
from lattica.sources import store as st
from lattica.sources.tables import table
from lattica.streaming import incremental as inc


@query("""SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'document' WHEN page_id % 5 = 1 THEN 'table' WHEN page_id % 5 = 2 THEN 'table' WHEN page_id % 5 = 3 THEN 'document' END AS kind FROM pages""")
def s6_source_kinds(spark, sf_dir):
    i = F.col("page_id") % 5
    named = F.when(i == 0, "Document").when(i == 1, "web_table")
    path = F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.when(i == 2, ".CSV").when(i == 3, ".txt").otherwise(".bin"))
    return table(spark, sf_dir, "pages").select("page_id", "url", rd.kind_of(named, path).alias("kind"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY doc_id) BETWEEN 11 AND 60")
def s3_metadata_slice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("source_type"))
    top = d.where("source_type = 'en'").orderBy("doc_id").limit(60)
    return rd.metadata(top, "en", 10, 60, "doc_id").select("doc_id", "source")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS local_id FROM part")
def s9_local_ids(spark, sf_dir):
    return rd.local_ids(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "p_brand", "local_id")


@query("SELECT o_custkey AS src, o_orderkey AS dst, CASE o_orderkey % 2 WHEN 0 THEN 'places' ELSE 'returns' END AS relation FROM orders WHERE o_custkey % 3 <> 0")
def s10_edge_arrays(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = o.withColumn("_p", F.pmod(F.xxhash64("o_orderkey"), F.lit(16))).groupBy("_p").agg(F.collect_list(F.struct("o_custkey", "o_orderkey", (F.col("o_orderkey") % 2).cast("int").alias("c"))).alias("e"))
    dump = parts.select(F.array(F.transform("e", lambda x: x["o_custkey"]), F.transform("e", lambda x: x["o_orderkey"])).alias("edge_index"), F.transform("e", lambda x: x["c"]).alias("edge_types"))
    names = spark.createDataFrame([(0, "customer___places___order"), (1, "customer___returns___order")], "code int, name string")
    nodes = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id")).unionByName(o.select(F.col("o_orderkey").alias("id")))
    found = rd.edge_arrays(dump, names, nodes)
    customers = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("src"))
    return found.join(customers, "src", "left_semi").select("src", "dst", "relation")


@query("SELECT p_partkey, trim(p_name)||' '||trim(p_brand)||CASE WHEN p_size % 2 = 0 THEN ' '||p_type ELSE '' END AS content FROM part")
def s12_node_content(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("maybe", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("NaN"))
    return p.select("p_partkey", rd.filled("p_name", "p_brand", "maybe").alias("content"))


@query("SELECT s_suppkey, 'supplier' AS kind, s_name||' in '||n_name||' ('||r_name||')' AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_custkey, 'customer', c_name||' '||c_mktsegment FROM customer")
def s13_typed_nodes(spark, sf_dir):
    s, n, r, c = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region", "customer"))
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = s.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit("supplier").alias("kind"), F.concat("s_name", F.lit(" in "), "n_name", F.lit(" ("), "r_name", F.lit(")")).alias("content"))
    return sup.unionByName(c.select(F.col("c_custkey").alias("s_suppkey"), F.lit("customer").alias("kind"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("content")))


@query("SELECT p_partkey, p_name AS title, string_agg(l_orderkey||':'||l_linenumber, ' | ' ORDER BY l_orderkey, l_linenumber) AS reviews, count(l_orderkey) AS n_reviews FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY ALL")
def s11_product_reviews(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))), " | ")
    return table(spark, sf_dir, "part").join(r, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("p_name").alias("title"), text.alias("reviews"), F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n_reviews"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5) SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY rank) FILTER (rank <= 3) AS first3, count(*) AS n FROM r GROUP BY 1")
def s14_wide_ranking(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    names = [rd.ordinal(i) for i in range(1, 6)]
    wide = r.withColumn("rank", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rank"))).groupBy("o_custkey").pivot("rank", names).agg(F.first("o_orderkey"))
    return wide.select("o_custkey", F.array_join(rd.wide_list(wide, 3), ",").alias("first3"), F.size(rd.wide_list(wide, 5)).cast("long").alias("n"))


@query("""WITH c AS (SELECT DISTINCT substr(md5(source), 1, 8)||'_'||substr(sha256(coalesce(text, '')), 1, 16) AS cache_key, doc_id % 2 = 0 AS cached FROM documents) SELECT cache_key FROM c GROUP BY 1 HAVING NOT bool_or(cached)""")
def s19_new_cache_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", st.cache_key(F.col("source"), F.coalesce("text", F.lit(""))).alias("cache_key"))
    return st.new_content(d.where("doc_id % 2 <> 0"), d.where("doc_id % 2 = 0")).select("cache_key")


@query("SELECT * FROM (VALUES ('title', 'main/title'), ('abstract', 'main/abstract'), ('field', 'field/name'), ('institution', 'inst/name')) t(feature, path)")
def s21_merged_manifest(spark, sf_dir):
    main = spark.createDataFrame([("title", "main/title"), ("abstract", "main/abstract")], "feature string, path string")
    field = spark.createDataFrame([("name", "field/name"), ("title", "field/title")], "feature string, path string")
    inst = spark.createDataFrame([("name", "inst/name")], "feature string, path string")
    return st.merged_manifest([(main, {}), (field, {"name": "field"}), (inst, {"name": "institution"})])


@query("""WITH i AS (SELECT c_custkey + 750 AS c_custkey, c_name||'*' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer)
SELECT coalesce(i.c_custkey, c.c_custkey) AS c_custkey, coalesce(i.c_name, c.c_name) AS c_name, round(coalesce(i.c_acctbal, c.c_acctbal), 2) AS c_acctbal FROM customer c FULL JOIN i ON i.c_custkey = c.c_custkey""")
def s22_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("v"))
    i = c.select((F.col("c_custkey") + 750).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("v"))
    return st.upsert(c, i, ["c_custkey"], "v").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT DISTINCT o_custkey AS src, o_orderkey + 1000000 AS dst, o_orderkey % 2 <> 0 AS swapped FROM orders JOIN customer ON c_custkey = o_custkey")
def s23_turned_edges(spark, sf_dir):
    o, big = table(spark, sf_dir, "orders"), F.col("o_orderkey") + 1_000_000
    even = F.col("o_orderkey") % 2 == 0
    edges = o.select(F.when(even, F.col("o_custkey")).otherwise(big).alias("src"), F.when(even, big).otherwise(F.col("o_custkey")).alias("dst"))
    types = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("type")).unionByName(o.select(big.alias("id"), F.lit("order").alias("type")))
    return st.oriented(edges, types, "customer", "order")


@query("SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN 'low' WHEN o_custkey < 1000 THEN 'middle' ELSE 'high' END AS kind FROM orders WHERE o_custkey BETWEEN 0 AND 100000000")
def s24_type_by_range(spark, sf_dir):
    kind = st.type_by_range(F.col("o_custkey"), {"low": (0, 499), "middle": (500, 999), "high": (1000, 100_000_000)})
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")).where("kind IS NOT NULL")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_size END AS size, p_type AS kind FROM part")
def s25_node_properties(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).otherwise(-1))
    return st.properties(p, {"p_partkey": "id", "p_name": "name", "p_size": "size", "p_type": "kind"})


@query("SELECT 'places' AS relation, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) UNION ALL SELECT 'contains', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'supplies', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'sits_in', count(*) FROM customer")
def s26_relation_counts(spark, sf_dir):
    return rd.union_all(list(tr.TypedGraph(spark, sf_dir).relations.values())).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, name, type FROM (SELECT p_partkey AS id, p_name AS name, 'part' AS type FROM part UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier) WHERE contains(lower(name), '7') AND type = 'supplier'")
def s28_name_search(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("type"))
    nodes = nodes.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type")))
    return rd.search_names(nodes, "7", "supplier")


@query("SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'document' ELSE 'table' END AS kind, count(*) OVER (PARTITION BY label % 2) AS n FROM embeddings")
def s15_graph_round_trip(spark, sf_dir):
    """Nodes after writing a graph as JSON and reading it again."""
    v = table(spark, sf_dir, "embeddings")
    nodes = v.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "document").otherwise("table").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit("s").alias("summary"))
    edges = nodes.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(None).cast("string").alias("edge_type"), F.lit(0.5).alias("similarity"))
    path = _folder(spark, "graph")
    rd.write_graph(nodes, edges, path)
    back, _ = rd.read_graph(spark, path)
    return back.select("id", "kind").join(back.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind").select("id", "kind", "n")


@query("SELECT o_orderkey % 4 AS batch, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1")
def s18_batch_results(spark, sf_dir):
    o, folder = table(spark, sf_dir, "orders").select("o_orderkey"), _folder(spark, "batches")
    for b in (0, 1, 2):
        rd.write_batch(o.where(F.col("o_orderkey") % 4 == b), folder, b)
    return rd.read_batches(spark, folder).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT vec_id AS id, greatest(0, least(1, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * label - 1)) > 0.5 AS strong, label FROM embeddings")
def d6_clamped_edges(spark, sf_dir):
    x = vx.dot("embedding", "embedding") * F.col("label") - 1
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (vx.clamped(x) > 0.5).alias("strong"), "label")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def t4_newer_events(spark, sf_dir):
    return st.newer_than(table(spark, sf_dir, "events"), "2024-01-15 00:00:00", "ts").select("event_id", "user_id")


def _folder(spark, name):
    """A new folder that driver and executors share."""
    g.settled(spark.range(1))  # sets a folder where none is set
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_STREAM = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 3 AS batch FROM embeddings),
p AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON b.batch <= a.batch AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM p QUALIFY r <= 10)"""


@query(f"WITH {_STREAM} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(sim), 6) AS sim FROM n WHERE sim >= 0.3 GROUP BY 1, 2")
def t3_incremental_graph(spark, sf_dir):
    """Edges after the vectors came in three arrivals, the first of them twice."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    arrivals, index, checkpoint = (_folder(spark, x) for x in ("arrivals", "index", "state"))
    for part in (0, 1, 2):
        v.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(arrivals)
        if part == 1:
            v.where(F.col("id") % 3 == 0).coalesce(1).write.mode("append").parquet(arrivals)
        inc.run_index(spark, arrivals, index, checkpoint).awaitTermination()
    _, edges = inc.read_index(spark, index)
    return edges.select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {_STREAM} SELECT (SELECT count(*) FROM e) AS n_vectors, (SELECT max(id) FROM e) AS last_id, count(*) AS n_edges FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM n WHERE sim >= 0.3)")
def t5_index_statistics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    arrivals, index, checkpoint = (_folder(spark, x) for x in ("arrivals", "index", "state"))
    for part in (0, 1, 2):
        v.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(arrivals)
        inc.run_index(spark, arrivals, index, checkpoint).awaitTermination()
    vectors, edges = inc.read_index(spark, index)
    return inc.statistics(vectors, edges)


@query("SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, sha256(text) FROM documents) GROUP BY doc_id")
def t2_each_chunk_once(spark, sf_dir):
    """Documents of a stream that brings everything twice."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    folder, checkpoint, out = (_folder(spark, x) for x in ("twice", "state", "once"))
    for _ in range(2):
        d.write.mode("append").parquet(folder)
        inc.new_chunks(spark, folder, "id long, digest string").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
