"""Graph statistics, components, paths, typed traversals, set operations and plans."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.operators import traversal as tr
from lattica.plans.vector_queries import KNN, _base, knn_edges
from lattica.sources.tables import table

EDGES = KNN + ", und AS (SELECT a AS src, b AS dst FROM edge UNION SELECT b, a FROM edge)"


def _edges(spark, sf_dir):
    return g.settled(knn_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim"))


@query(f"""WITH {EDGES} SELECT 'nodes by label' AS what, label::VARCHAR AS value, count(*) AS n FROM e GROUP BY label UNION ALL
SELECT 'edges by type', CASE WHEN x.label = y.label THEN 'same' ELSE 'different' END, count(*) FROM edge JOIN e x ON a = x.vec_id JOIN e y ON b = y.vec_id GROUP BY 2""")
def a1_counts_by_type(spark, sf_dir):
    labels = _base(spark, sf_dir).select("id", "label")
    nodes = labels.groupBy(F.col("label").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes by label").alias("what"), "value", "n")
    e = knn_edges(spark, sf_dir).join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    kinds = e.groupBy(F.when(F.col("x") == F.col("y"), "same").otherwise("different").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(kinds.select(F.lit("edges by type").alias("what"), "value", "n"))


_REACH = "reach(id, node) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, u.dst FROM reach r JOIN und u ON r.node = u.src), comp AS (SELECT id, min(node) AS component FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {EDGES}, {_REACH} SELECT (SELECT count(*) FROM e) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, round(2.0 * (SELECT count(*) FROM edge) / ((SELECT count(*) FROM e) * ((SELECT count(*) FROM e) - 1))::DOUBLE, 9) AS density, count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected FROM comp")
def a2_density(spark, sf_dir):
    nodes, edges = _base(spark, sf_dir), _edges(spark, sf_dir)
    c = g.components(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return c.crossJoin(m).select("n_nodes", "n_edges", F.round(2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9).alias("density"), "n_components", (F.col("n_components") == 1).alias("connected"))


@query(f"WITH RECURSIVE {EDGES}, {_REACH} SELECT id, component FROM comp")
def g1_components(spark, sf_dir):
    return g.components(_base(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, {_REACH}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT size, count(*) AS n_components, (SELECT max(size) FROM sz) AS largest, (SELECT min(size) FROM sz) AS smallest, round((SELECT avg(size) FROM sz), 6) AS mean FROM sz GROUP BY size")
def a29_component_statistics(spark, sf_dir):
    sizes = g.components(_base(spark, sf_dir), _edges(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    every = sizes.agg(F.max("size").alias("largest"), F.min("size").alias("smallest"), F.round(F.avg("size"), 6).alias("mean"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_components")).crossJoin(F.broadcast(every))


@query(f"WITH RECURSIVE {EDGES}, {_REACH} SELECT a.id AS src, b.id AS dst, a.component FROM comp a JOIN comp b USING (component) WHERE a.id % 100 = 0 AND a.id <> b.id")
def g2_matches_in_component(spark, sf_dir):
    """Origins are the stated query set; every row of their components is a match."""
    c = g.components(_base(spark, sf_dir), _edges(spark, sf_dir))
    q = c.where("id % 100 = 0").withColumnRenamed("id", "src")
    return q.join(c.withColumnRenamed("id", "dst"), "component").where("src <> dst").select("src", "dst", "component")


_LEVELS = """bfs(origin, id, depth) AS (SELECT vec_id, vec_id, 0 FROM e WHERE vec_id % 100 = 0 UNION SELECT r.origin, u.dst, r.depth + 1 FROM bfs r JOIN und u ON r.id = u.src WHERE r.depth < 12),
lev AS (SELECT origin, id, min(depth) AS depth FROM bfs GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {EDGES}, {_LEVELS} SELECT origin, id AS target, depth FROM lev WHERE id <> origin")
def g3_shortest_paths(spark, sf_dir):
    """Origins are the stated query set; every reached row is a target."""
    origins = _base(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("origin"))
    return g.levels(_edges(spark, sf_dir), origins).where("origin <> id").select("origin", F.col("id").alias("target"), "depth")


@query(f"WITH RECURSIVE {EDGES}, {_LEVELS} SELECT origin, count(*) AS reached, max(depth) AS eccentricity, round(avg(depth), 6) AS mean, count(*) FILTER (depth = 1) AS one, count(*) FILTER (depth = 2) AS two, round(quantile_cont(depth, 0.9), 6)::DOUBLE AS p90 FROM lev WHERE depth > 0 GROUP BY 1")
def a23_path_length_statistics(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    lev = g.levels(edges, _base(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("origin"))).where("depth > 0")
    return lev.groupBy("origin").agg(
        F.count(F.lit(1)).alias("reached"), F.max("depth").alias("eccentricity"), F.round(F.avg("depth"), 6).alias("mean"), F.count_if(F.col("depth") == 1).alias("one"), F.count_if(F.col("depth") == 2).alias("two"),
        F.round(F.expr("percentile(depth, 0.9)"), 6).alias("p90"),
    )


@query(f"""WITH {EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM und GROUP BY 1), s AS (SELECT src AS id, dst, sim FROM und JOIN edge ON a = least(src,dst) AND b = greatest(src,dst))
SELECT vec_id AS id, coalesce(degree, 0) AS degree, (SELECT string_agg(dst, ',' ORDER BY round(sim, 9) DESC, dst) FROM (SELECT dst, sim FROM s WHERE s.id = vec_id ORDER BY round(sim, 9) DESC, dst LIMIT 10)) AS top FROM e LEFT JOIN d ON d.id = vec_id""")
def g4_node_details(spark, sf_dir):
    e = _edges(spark, sf_dir)
    both = e.select("src", "dst", "sim").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    ranked = both.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc(F.round("sim", 9)), "dst")))
    top = ranked.where("r <= 10").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("r", "dst"))).alias("t"))
    n = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    rows = _base(spark, sf_dir).select("id").join(n, F.col("id") == n.src, "left").drop("src").join(top, F.col("id") == top.src, "left")
    return rows.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.array_join(F.transform("t", lambda x: x["dst"].cast("string")), ",").alias("top"))


@query(f"WITH RECURSIVE {EDGES}, b(origin, id, depth) AS (SELECT DISTINCT src, src, 0 FROM und UNION SELECT r.origin, u.dst, r.depth + 1 FROM b r JOIN und u ON r.id = u.src WHERE r.depth < 16), l AS (SELECT origin, id, min(depth) AS depth FROM b GROUP BY 1, 2) SELECT max(depth) AS longest FROM l")
def g5_diameter(spark, sf_dir):
    """Longest shortest path of the whole graph (its largest, if it isn't connected)."""
    return g.eccentricities(_edges(spark, sf_dir)).agg(F.max("depth").alias("longest"))


@query(f"""WITH {EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM und GROUP BY 1), t AS (SELECT x.src AS id, count(*) / 2 AS triangles FROM und x JOIN und y ON x.dst = y.src JOIN und z ON y.dst = z.src AND z.dst = x.src GROUP BY 1)
SELECT d.id, degree, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2.0)::DOUBLE ELSE 0 END, 9) AS coefficient FROM d LEFT JOIN t USING (id)""")
def g6_clustering(spark, sf_dir):
    return g.clustering(_edges(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 9))


@query(f"WITH {EDGES} SELECT a AS src, b AS dst, round(sim, 6) AS sim FROM edge JOIN e x ON a = x.vec_id JOIN e y ON b = y.vec_id WHERE x.label < 5 AND y.label < 5")
def g7_induced_subgraph(spark, sf_dir):
    nodes = _base(spark, sf_dir).where("label < 5").select("id")
    return g.induced(_edges(spark, sf_dir), nodes).withColumn("sim", F.round("sim", 6))


@query()
def g8_communities(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumnRenamed("sim", "weight")
    return g.communities(e)


@query(f"""WITH {EDGES}, s AS (SELECT src, sum(sim) AS k FROM und JOIN edge ON a = least(src,dst) AND b = greatest(src,dst) GROUP BY 1), m AS (SELECT sum(sim) AS m FROM edge),
i AS (SELECT x.label, sum(sim) AS inside FROM edge JOIN e x ON a = x.vec_id JOIN e y ON b = y.vec_id WHERE x.label = y.label GROUP BY 1), c AS (SELECT label, sum(k) AS k FROM s JOIN e ON src = vec_id GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m - pow(k / (2 * m), 2)), 9) AS modularity FROM c LEFT JOIN i USING (label), m""")
def g8_modularity(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumnRenamed("sim", "weight")
    return g.modularity(e, _base(spark, sf_dir).select("id", F.col("label").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query(f"""WITH {EDGES}, h AS (SELECT x.src AS id, y.dst AS far FROM und x JOIN und y ON x.dst = y.src WHERE y.dst <> x.src AND NOT EXISTS (SELECT 1 FROM und z WHERE z.src = x.src AND z.dst = y.dst))
SELECT vec_id AS id, (SELECT count(*) FROM und WHERE src = vec_id) AS one, (SELECT count(DISTINCT far) FROM h WHERE h.id = vec_id) AS two FROM e""")
def g9_hop_counts(spark, sf_dir):
    both = g.settled(g.both_ways(_edges(spark, sf_dir)))
    one = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("one"))
    far = both.alias("x").join(both.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).where("src <> dst").distinct()
    two = far.join(both, ["src", "dst"], "left_anti").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("two"))
    return _base(spark, sf_dir).select("id").join(one, "id", "left").join(two, "id", "left").na.fill(0, ["one", "two"])


@query(f"WITH {EDGES} SELECT count(*) FILTER (a % 7 <> 0 AND b % 7 <> 0) AS accepted, count(*) FILTER (a % 7 = 0 OR b % 7 = 0) AS rejected FROM edge")
def g10_validated_edges(spark, sf_dir):
    nodes = _base(spark, sf_dir).where("id % 7 <> 0").select("id")
    e = _edges(spark, sf_dir)
    good = g.induced(e, nodes).agg(F.count(F.lit(1)).alias("accepted"))
    return good.crossJoin(g.rejected(e, nodes).agg(F.count(F.lit(1)).alias("rejected")))


@query(f"WITH {EDGES} SELECT src, string_agg(dst, ',' ORDER BY dst) AS adjacent FROM und GROUP BY src")
def g11_adjacency(spark, sf_dir):
    lists = g.both_ways(_edges(spark, sf_dir)).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("d"))
    return lists.select("src", F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("adjacent"))


@query()
def g12_projection(spark, sf_dir):
    """Two principal components of the vectors, as coordinates."""
    rows = _base(spark, sf_dir).select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    return out.select("id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


@query(f"""WITH {EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM und GROUP BY 1) SELECT vec_id AS id, greatest(10, least(30, 10 + 2 * coalesce(degree, 0))) AS size, CASE WHEN label % 2 = 0 THEN 'document' ELSE 'table' END AS kind, substr(md5(vec_id||':'||coalesce(degree, 0)), 1, 8) AS version FROM e LEFT JOIN d ON d.id = vec_id""")
def g13_display_nodes(spark, sf_dir):
    n = _base(spark, sf_dir).select("id", "label").join(g.degrees(_edges(spark, sf_dir)), "id", "left").na.fill(0, ["degree"])
    version = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("degree").cast("string")).cast("binary")), 1, 8)
    return n.select("id", F.greatest(F.lit(10), F.least(F.lit(30), 10 + 2 * F.col("degree"))).alias("size"), F.when(F.col("label") % 2 == 0, "document").otherwise("table").alias("kind"), version.alias("version"))


@query(f"WITH {EDGES} SELECT a, b, greatest(1, round(8 * sim, 6)) AS width FROM edge WHERE sim >= 0.31 QUALIFY row_number() OVER (ORDER BY round(sim, 9) DESC, a, b) <= 500")
def o3_sampled_edges(spark, sf_dir):
    e = knn_edges(spark, sf_dir).where("sim >= 0.31").withColumn("s", F.round("sim", 9)).orderBy(F.desc("s"), "a", "b").limit(500)
    return e.select("a", "b", F.greatest(F.lit(1.0), F.round(8 * F.col("sim"), 6)).alias("width"))


# Typed graph: customers place orders that contain parts; suppliers supply parts.


@query("SELECT DISTINCT o_custkey AS seed, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 100 = 0")
def g14_two_relations(spark, sf_dir):
    t = tr.TypedGraph(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("id"))
    placed = t.neighbours(seeds, "places").select("seed", "id")
    return placed.join(t.relations["contains"], F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()


@query("SELECT DISTINCT l_partkey AS seed, o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 100 = 0")
def g14_reverse_relations(spark, sf_dir):
    t = tr.TypedGraph(spark, sf_dir)
    seeds = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    held = t.neighbours(seeds, "contains", reverse=True)
    return held.join(t.relations["places"].select(F.col("dst").alias("id"), F.col("src").alias("customer")), "id").select("seed", F.col("customer").alias("id")).distinct()


@query("WITH n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) SELECT n_name, o_orderkey, o_custkey FROM n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def j14_composite_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # a nation table is 25 rows at every scale
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "o_orderkey", "o_custkey")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT DISTINCT a.src AS seed, b.src AS id FROM r a JOIN r b USING (dst) WHERE a.src % 20 = 0 AND a.src <> b.src""")
def j13_co_sources(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("id"))
    return tr.co_neighbours(tr.TypedGraph(spark, sf_dir).relations["supplies"], seeds)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT a.dst AS seed, b.dst AS id, count(DISTINCT a.src) AS support FROM r a JOIN r b USING (src) WHERE a.dst % 100 = 0 AND a.dst <> b.dst GROUP BY ALL HAVING count(DISTINCT a.src) >= 2""")
def j12_shared_targets(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    return tr.co_targets(tr.TypedGraph(spark, sf_dir).relations["contains"], seeds)


@query(f"WITH {EDGES}, s AS (SELECT src AS qid, dst AS id FROM nn WHERE src % 100 = 0 AND rank <= 5) SELECT DISTINCT qid, u.dst AS id FROM s JOIN und u ON u.src = s.id WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.qid = s.qid AND t.id = u.dst)")
def j8_new_neighbours(spark, sf_dir):
    base = _base(spark, sf_dir)
    seeds = g.settled(knn.search(base.where("id % 100 = 0"), base, 5).select(F.col("src").alias("qid"), F.col("dst").alias("id")))
    return g.one_hop(seeds, _edges(spark, sf_dir), ["qid"])


@query("""WITH l AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents), c AS (SELECT doc_id, doc_id||'_chunk_'||i AS chunk FROM documents, generate_series(0, 1) t(i)),
p AS (SELECT x.chunk AS src, y.chunk AS dst FROM l JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b) SELECT src, dst FROM p UNION SELECT dst, src FROM p""")
def j9_structural_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    link = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("b")).where("b IS NOT NULL")
    chunk = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i")).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("i").cast("string")).alias("chunk"))
    p = link.join(chunk.select(F.col("doc_id").alias("a"), F.col("chunk").alias("src")), "a").join(chunk.select(F.col("doc_id").alias("b"), F.col("chunk").alias("dst")), "b").select("src", "dst")
    return g.both_ways(p)


@query("SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j10_metadata_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def f2_year_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year")).where(F.col("year").between(1994, 1996))


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_brand = (SELECT min(p_brand) FROM part)")
def f3_criteria(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    brand = p.agg(F.min("p_brand")).first()[0]
    return tr.matching(p, {"p_size": {"min": 10, "max": 20}, "p_brand": brand}).select("p_partkey")


@query("SELECT o_orderkey, year(o_orderdate) AS year, row_number() OVER (ORDER BY coalesce(year(o_orderdate), 9999), o_orderkey) AS position FROM orders QUALIFY position <= 100")
def o6_year_order(spark, sf_dir):
    top = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year")).orderBy(F.coalesce("year", F.lit(9999)), "o_orderkey").limit(100)
    return top.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.coalesce("year", F.lit(9999)), "o_orderkey")).cast("long"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def o2_top_per_group(spark, sf_dir):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("c_custkey", "c_mktsegment", "rank")


@query("SELECT doc_id, CAST(conv AS BIGINT) AS part FROM (SELECT doc_id, ('0x'||substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS conv FROM documents)")
def o4_hash_partition(spark, sf_dir):
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return table(spark, sf_dir, "documents").select("doc_id", part.alias("part"))


@query("WITH c AS (SELECT doc_id, greatest(1, least(10, length(text) / 1000.0))::DOUBLE AS cost FROM documents) SELECT round(sum(cost), 6) AS total, round(max(cost), 6) AS most, count(*) AS n FROM c")
def o5_cost_balance(spark, sf_dir):
    cost = F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.length("text") / 1000.0))
    return table(spark, sf_dir, "documents").select(cost.alias("cost")).agg(F.round(F.sum("cost"), 6).alias("total"), F.round(F.max("cost"), 6).alias("most"), F.count(F.lit(1)).alias("n"))


def _sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    big = o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    late = o.where("year(o_orderdate) >= 1997").select(F.col("o_custkey").alias("id"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return [big, late, rich]


_A, _B, _C = "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000", "SELECT o_custkey AS id FROM orders WHERE year(o_orderdate) >= 1997", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0"


@query(f"{_A} INTERSECT {_B} INTERSECT {_C}")
def u1_intersection(spark, sf_dir):
    return tr.intersection(_sets(spark, sf_dir))


@query(f"{_A} UNION {_B} UNION {_C}")
def u2_union(spark, sf_dir):
    return tr.union(_sets(spark, sf_dir))


@query(f"{_C} EXCEPT ({_A})")
def u3_difference(spark, sf_dir):
    big, _, rich = _sets(spark, sf_dir)
    return rich.distinct().join(big.distinct(), "id", "left_anti")


@query("SELECT o_custkey AS id, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def u4_ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("first_seen"))


@query(f"({_A}) INTERSECT ({_C})")
def u5_step_intersection(spark, sf_dir):
    big, _, rich = _sets(spark, sf_dir)
    return big.intersect(rich)


def actions(spark, sf_dir):
    """Actions that a plan can name."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))

    def customers_of_nation(nation):
        return c.join(F.broadcast(n.where(F.col("n_name") == nation)), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"))

    def orders_of_nation(nation):
        return o.join(customers_of_nation(nation), F.col("o_custkey") == F.col("id")).select(F.col("o_orderkey").alias("id"))

    def orders_in_years(first, last):
        return o.where(F.year("o_orderdate").between(first, last)).select(F.col("o_orderkey").alias("id"))

    def parts_of_nation(nation):
        return orders_of_nation(nation).join(table(spark, sf_dir, "lineitem"), F.col("id") == F.col("l_orderkey")).select(F.col("l_partkey").alias("id")).distinct()

    return {f.__name__: f for f in (customers_of_nation, orders_of_nation, orders_in_years, parts_of_nation)}


@query("SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 UNION SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def q1_plan(spark, sf_dir):
    plan = [{"action": "orders_in_years", "params": {"first": 1995, "last": 1996}}, {"action": "no_such_action"}, {"action": "orders_of_nation", "params": {"nation": "NATION_3"}}]
    return tr.execute(plan, actions(spark, sf_dir))[0]


@query("SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 UNION SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5'")
def q2_plan_of_question(spark, sf_dir):
    return tr.execute(tr.plan_of("Which order between 1994 and 1996, or from NATION_5?"), actions(spark, sf_dir))[0]


@query("""SELECT o_orderkey AS id, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND year(o_orderdate) BETWEEN greatest(1950, 1996 - 1) AND least(2024, 1996 + 1)""")
def q4_author_topic_window(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(max(1950, 1995), min(2024, 1997)))
    return o.join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), "o_custkey")


@query("""WITH best AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 1)
SELECT l_orderkey AS id, 'holds' AS how FROM lineitem JOIN best ON l_partkey = p_partkey UNION ALL SELECT l_suppkey, 'supplies' FROM lineitem JOIN best ON l_partkey = p_partkey""")
def q5_citation_strategy(spark, sf_dir):
    best = table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(1).select("p_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(F.broadcast(best), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("id"), F.lit("holds").alias("how")).unionAll(rows.select(F.col("l_suppkey").alias("id"), F.lit("supplies").alias("how")))


@query("""WITH c AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 2), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 100), p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS shared FROM lineitem JOIN p USING (l_partkey) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY 1 ORDER BY shared DESC, id LIMIT 10""")
def q12_end_to_end(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(2).select("c_custkey")
    o = table(spark, sf_dir, "orders").join(F.broadcast(c), F.col("o_custkey") == F.col("c_custkey")).orderBy("o_orderkey").limit(100).select(F.col("o_orderkey").alias("l_orderkey"))
    p = li.join(F.broadcast(o), "l_orderkey", "left_semi").select("l_partkey").distinct()
    shared = li.join(p, "l_partkey", "left_semi").join(F.broadcast(o), "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_partkey").alias("shared"))
    return shared.orderBy(F.desc("shared"), "id").limit(10)
