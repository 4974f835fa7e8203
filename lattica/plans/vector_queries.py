"""Vector functions, exact and indexed search, neighbour lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import vectors as vx
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.sources.tables import table

DIM, HALF = 64, 32
QUERIES = "vec_id % 100 = 0"
SIM = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0)"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _base(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _top(spark, sf_dir, k, **more):
    base = _base(spark, sf_dir)
    return knn.search(base.where("id % 100 = 0"), base, k, **more)


def _features(spark, sf_dir):
    v = F.col("embedding")
    return knn.features(_embeddings(spark, sf_dir), "vec_id", {"head": F.slice(v, 1, HALF), "tail": F.slice(v, HALF + 1, HALF)})


@query(f"""WITH {SIM}, p AS (SELECT q.vec_id AS src, e.vec_id AS dst, list_cosine_similarity(q.v, e.v) AS c, list_distance(q.v, e.v) AS d FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT src, dst, round(c,6) AS cosine, round(greatest(0,c),6) AS clipped, round(1 - d*d/2,6) AS from_squared, round(1/(1+d*d),6) AS score, round(greatest(0,least(1,c)),6) AS clamped FROM p""")
def v1_vector_functions(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    q = e.where(QUERIES).select(F.col("vec_id").alias("src"), F.col("embedding").alias("a"))
    p = e.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b")).join(q, F.col("src") != F.col("dst"))
    p = p.select("src", "dst", vx.cosine("a", "b").alias("c"), vx.cosine_or_zero("a", "b").alias("z"), vx.squared_distance("a", "b").alias("d"))
    return p.select("src", "dst", F.round("c", 6).alias("cosine"), F.round("z", 6).alias("clipped"), F.round(vx.similarity_of_squared(F.col("d")), 6).alias("from_squared"), F.round(vx.score_of_distance(F.col("d")), 6).alias("score"), F.round(vx.clamped(F.col("c")), 6).alias("clamped"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS squared_norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first_unit FROM embeddings")
def v4_unit_vectors(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(vx.dot("embedding", "embedding"), 5).alias("squared_norm"), F.round(vx.normalised("embedding")[0], 5).alias("first_unit"))


@query("""WITH m AS (SELECT label, i AS dim, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) t(i) GROUP BY ALL) SELECT label, dim - 1 AS dim, round(x, 6) + 0.0 AS mean FROM m""")
def v7_mean_vectors(spark, sf_dir):
    m = vx.mean_vectors(_embeddings(spark, sf_dir), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + F.lit(0.0)).alias("mean"))


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def e7_valid_vectors(spark, sf_dir):
    return _embeddings(spark, sf_dir).where(vx.is_valid("embedding", DIM)).select("vec_id", "label")


@query("""WITH v AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN NULL ELSE embedding END AS v FROM embeddings) SELECT vec_id, v IS NULL AS filled, len(coalesce(v, list_resize([]::FLOAT[], 64, 0::FLOAT))) AS size, round(coalesce(list_sum(v::DOUBLE[]), 0), 6) AS total FROM v""")
def e6_zero_filled(spark, sf_dir):
    v = F.when(F.col("label") % 3 != 0, F.col("embedding"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    filled = F.coalesce(v, zero)
    return _embeddings(spark, sf_dir).select("vec_id", v.isNull().alias("filled"), F.size(filled).cast("long").alias("size"), F.round(F.aggregate(filled.cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {SIM}, r AS (SELECT q.vec_id AS src, e.vec_id AS dst, list_cosine_similarity(q.v,e.v) AS sim FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT src, dst, round(sim,6) AS sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM r QUALIFY rank <= 5""")
def k1_topk_similarity(spark, sf_dir):
    return _top(spark, sf_dir, 5).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


KNN = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v,b.v) AS sim FROM e a, e b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM pr QUALIFY rank <= 10),
edge AS (SELECT least(src,dst) AS a, greatest(src,dst) AS b, max(sim) AS sim FROM nn WHERE sim >= 0.3 GROUP BY ALL)"""


def knn_edges(spark, sf_dir, k=10, least=0.3):
    """Canonical edges a < b with sim of the k-nearest-neighbour graph at a similarity of at least `least`."""
    base = _base(spark, sf_dir)
    return knn.canonical(knn.search(base, base, k, least=least))


@query(f"WITH {KNN} SELECT a, b, round(sim,6) AS sim FROM edge")
def j2_knn_graph(spark, sf_dir):
    return knn_edges(spark, sf_dir).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH RECURSIVE {KNN}, th AS (SELECT src, dst FROM pr WHERE sim >= 0.3),
reach(id, node) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, t.dst FROM reach r JOIN th t ON r.node = t.src)
SELECT vec_id, coalesce(n, 0) AS n_links, component FROM e LEFT JOIN (SELECT src, count(*) AS n FROM th GROUP BY 1) ON src = vec_id JOIN (SELECT id, min(node) AS component FROM reach GROUP BY 1) ON id = vec_id""")
def j1_threshold_join(spark, sf_dir):
    base = _base(spark, sf_dir)
    edges = g.settled(knn.search(base, base, least=0.3).select("src", "dst"))
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_links"))
    return g.components(base, edges).join(n, F.col("id") == F.col("src"), "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component")


@query(f"""WITH {KNN}, t AS (SELECT src, dst, sim, x.label % 2 AS ta, y.label % 2 AS tb FROM nn JOIN e x ON x.vec_id = src JOIN e y ON y.vec_id = dst),
k AS (SELECT least(src,dst) AS a, greatest(src,dst) AS b, CASE WHEN ta = 1 AND tb = 1 THEN 'table-table' WHEN ta = 0 AND tb = 0 THEN 'doc-doc' ELSE 'doc-table' END AS edge_type, sim FROM t)
SELECT a, b, edge_type, round(max(sim),6) AS sim FROM k WHERE sim >= CASE WHEN edge_type = 'doc-doc' THEN 0.3 ELSE 0.35 END GROUP BY a, b, edge_type""")
def j3_typed_thresholds(spark, sf_dir):
    base = _base(spark, sf_dir)
    kinds = base.select("id", F.when(F.col("label") % 2 == 1, "table").otherwise("doc").alias("kind"))
    edges = knn.canonical(knn.search(base, base, 10, least=0.3))
    typed = edges.join(kinds.select(F.col("id").alias("a"), F.col("kind").alias("ka")), "a").join(kinds.select(F.col("id").alias("b"), F.col("kind").alias("kb")), "b")
    kind = F.when(F.col("ka") == F.col("kb"), F.concat_ws("-", "ka", "kb")).otherwise("doc-table")
    least = F.when(F.col("edge_type") == "doc-doc", 0.3).otherwise(0.35)
    return typed.withColumn("edge_type", kind).where(F.col("sim") >= least).select("a", "b", "edge_type", F.round("sim", 6).alias("sim"))


@query(f"WITH {KNN} SELECT count(DISTINCT (least(src,dst), greatest(src,dst))) AS n_pairs, count(*) AS n_lists FROM nn")
def j5_unique_pairs(spark, sf_dir):
    base = _base(spark, sf_dir)
    found = knn.search(base, base, 10)
    pairs = found.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n_lists"))


@query(f"WITH {KNN} SELECT a, b, round(sim,6) AS sim, x.label FROM edge JOIN e x ON a = x.vec_id JOIN e y ON b = y.vec_id WHERE x.label = y.label")
def j6_same_type_pairs(spark, sf_dir):
    labels = _base(spark, sf_dir).select("id", "label")
    e = knn_edges(spark, sf_dir)
    typed = e.join(labels.select(F.col("id").alias("a"), "label"), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return typed.where("label = lb").select("a", "b", F.round("sim", 6).alias("sim"), "label")


def _cut_sql(source, keys):
    part = ", ".join(keys)
    return f"""st AS (SELECT *, lead(distance) OVER w - distance AS step, CASE WHEN distance > 0 THEN (lead(distance) OVER w - distance)/distance*100 WHEN lead(distance) OVER w > 0 THEN 'inf'::DOUBLE WHEN lead(distance) OVER w IS NOT NULL THEN 0 END AS rise FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY rank)),
ct AS (SELECT {part}, quantile_cont(rise, 0.95) FILTER (rise < 'inf'::DOUBLE) AS rc, quantile_cont(step, 0.95) AS sc, count(rise) FILTER (rise < 'inf'::DOUBLE) AS nf, count(step) AS ns FROM st GROUP BY ALL),
sp AS (SELECT {part}, CASE WHEN any_value(ns) > 0 AND any_value(nf) = 0 THEN 1 ELSE min(rank) FILTER ((rise = 'inf'::DOUBLE OR rise >= rc) AND step >= greatest(sc, 0.01)) END AS stop FROM st JOIN ct USING ({part}) GROUP BY ALL)
SELECT {part}, dst, rank, round(distance, 6) AS distance FROM {source} JOIN sp USING ({part}) WHERE stop IS NULL OR rank <= stop"""


@query(f"""WITH {SIM}, f AS (SELECT q.vec_id AS src, e.vec_id AS dst, round(2-2*list_cosine_similarity(q.v,e.v), 9) AS distance FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM f QUALIFY rank <= 25), {_cut_sql("r", ["src"])}""")
def k3_adaptive_cut(spark, sf_dir):
    found = _top(spark, sf_dir, knn.FIRST).withColumn("distance", F.round(2 - 2 * F.col("sim"), 9))
    return knn.adaptive_cut(found, ["src"]).select("src", "dst", "rank", F.round("distance", 6).alias("distance"))


FEATURES = """f AS (SELECT vec_id AS id, 'head' AS feature, embedding[1:32]::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id, 'tail', embedding[33:64]::DOUBLE[] FROM embeddings),
fq AS (SELECT * FROM f WHERE id % 100 = 0),
fp AS (SELECT x.id AS src, y.id AS dst, x.feature, list_cosine_similarity(x.v, y.v) AS sim FROM fq x JOIN f y ON x.feature = y.feature AND x.id <> y.id),
fn AS (SELECT *, row_number() OVER (PARTITION BY feature, src ORDER BY sim DESC, dst) AS rank FROM fp QUALIFY rank <= 25)"""


def _feature_top(spark, sf_dir, k=knn.FIRST):
    f = _features(spark, sf_dir)
    return knn.search(f.where("id % 100 = 0"), f, k, on=[("feature", "feature")])


@query(f"WITH {FEATURES}, r AS (SELECT src, dst, feature, rank, round(2-2*sim, 9) AS distance FROM fn), {_cut_sql('r', ['feature', 'src'])}")
def k4_multi_feature_search(spark, sf_dir):
    found = _feature_top(spark, sf_dir).withColumn("distance", F.round(2 - 2 * F.col("sim"), 9))
    return knn.adaptive_cut(found, ["feature", "src"]).select("feature", "src", "dst", "rank", F.round("distance", 6).alias("distance"))


@query(f"""WITH {FEATURES}, r AS (SELECT x.id AS src, y.id AS dst, list_cosine_similarity(x.v, y.v) AS sim FROM fq x, f y WHERE x.feature = 'head' AND y.feature = 'tail' AND x.id <> y.id)
SELECT src, dst, round(sim,6) AS sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM r QUALIFY rank <= 10""")
def j4_cross_feature_join(spark, sf_dir):
    f = _features(spark, sf_dir)
    return knn.search(f.where("feature = 'head' AND id % 100 = 0"), f.where("feature = 'tail'"), 10).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {FEATURES} SELECT feature, src, dst, rank, round(sim,6) AS sim FROM fn WHERE rank <= 5")
def k5_feature_neighbour_lists(spark, sf_dir):
    return _feature_top(spark, sf_dir, 5).select("feature", "src", "dst", "rank", F.round("sim", 6).alias("sim"))


@query(f"WITH {FEATURES} SELECT feature, src, string_agg(dst, ',' ORDER BY rank) FILTER (rank <= 3) AS kept FROM fn GROUP BY ALL")
def k6_trimmed_lists(spark, sf_dir):
    lists = _feature_top(spark, sf_dir).groupBy("feature", "src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("l"))
    return lists.select("feature", "src", F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["dst"].cast("string")), ",").alias("kept"))


@query(f"WITH {FEATURES}, s AS (SELECT src, dst, sum(sim * CASE feature WHEN 'head' THEN 3.0 ELSE 2.0 END) AS score FROM fn GROUP BY ALL) SELECT src, dst, round(score,6) AS score, row_number() OVER (PARTITION BY src ORDER BY round(score,9) DESC, dst) AS rank FROM s")
def k9_weighted_fusion(spark, sf_dir):
    s = knn.weighted_fusion(_feature_top(spark, sf_dir), {"head": 3.0, "tail": 2.0})
    w = W.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return s.select("src", "dst", F.round("score", 6).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {FEATURES} SELECT DISTINCT src, dst FROM fn WHERE rank <= 10")
def k10_union_of_hits(spark, sf_dir):
    return _feature_top(spark, sf_dir, 10).select("src", "dst").distinct()


@query(f"""WITH {FEATURES}, seed AS (SELECT src AS qid, dst AS id FROM fn WHERE feature = 'head' AND rank <= 3),
ff AS (SELECT x.id AS src, y.id AS dst, x.feature, list_cosine_similarity(x.v, y.v) AS sim FROM f x JOIN f y ON x.feature = y.feature AND x.id <> y.id WHERE x.id IN (SELECT id FROM seed)),
nb AS (SELECT *, row_number() OVER (PARTITION BY feature, src ORDER BY sim DESC, dst) AS r FROM ff QUALIFY r <= 5)
SELECT DISTINCT qid, dst AS id FROM seed JOIN nb ON src = id WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.qid = seed.qid AND s.id = nb.dst)""")
def k11_neighbours_of_hits(spark, sf_dir):
    f = _features(spark, sf_dir)
    seeds = g.settled(_feature_top(spark, sf_dir, 3).where("feature = 'head'").select(F.col("src").alias("qid"), F.col("dst").alias("id")))
    near = knn.search(f.join(seeds.select("id").distinct(), "id", "left_semi"), f, 5, on=[("feature", "feature")])
    found = seeds.join(near, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id")).distinct()
    return found.join(seeds, ["qid", "id"], "left_anti")


@query(f"WITH {FEATURES} SELECT src, dst, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features, round(max(sim),6) AS sim FROM fn GROUP BY src, dst")
def k13_provenance(spark, sf_dir):
    return knn.provenance(_feature_top(spark, sf_dir)).select("src", "dst", "features", F.round("sim", 6).alias("sim"))


@query()
def k2_indexed_search(spark, sf_dir):
    base = _base(spark, sf_dir)
    return knn.InvertedFile(base).search(base.where("id % 100 = 0"), 10).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH {KNN}, q AS (SELECT vec_id, label FROM e WHERE vec_id % 100 = 0), top AS (SELECT src, dst, sim, rank FROM nn WHERE src IN (SELECT vec_id FROM q) AND rank <= 5),
und AS (SELECT a AS src, b AS dst FROM edge UNION SELECT b, a FROM edge),
grow AS (SELECT DISTINCT t.src, u.dst FROM top t JOIN und u ON t.dst = u.src WHERE u.dst <> t.src AND NOT EXISTS (SELECT 1 FROM top s WHERE s.src = t.src AND s.dst = u.dst)),
cand AS (SELECT src, dst, true AS direct FROM top UNION ALL SELECT src, dst, false FROM grow),
sc AS (SELECT c.src, c.dst, direct, round(pr.sim * CASE WHEN direct THEN 1.5 ELSE 1 END, 9) AS score FROM cand c JOIN pr USING (src, dst)),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM sc QUALIFY rank <= 10),
gold AS (SELECT q.vec_id AS src, count(*) AS n FROM q JOIN e ON e.label = q.label AND e.vec_id <> q.vec_id GROUP BY 1)
SELECT rk.src, count(*) AS n, max((e.label = q.label)::INT) AS hit, round(sum((e.label = q.label)::INT) / any_value(gold.n)::DOUBLE, 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (e.label = q.label), 0)::DOUBLE, 6) AS mrr FROM rk JOIN e ON e.vec_id = dst JOIN q ON q.vec_id = rk.src JOIN gold ON gold.src = rk.src GROUP BY rk.src""")
def k1_graph_expanded_retrieval(spark, sf_dir):
    base = _base(spark, sf_dir)
    q = base.where("id % 100 = 0")
    top = g.settled(knn.search(q, base, 5).select("src", "dst", "sim"))
    edges = knn_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    near = g.one_hop(top.select(F.col("src").alias("qid"), F.col("dst").alias("id")), edges, ["qid"]).where("qid <> id").select(F.col("qid").alias("src"), F.col("id").alias("dst"))
    vec = lambda name, other: base.select(F.col("id").alias(name), F.col("vector").alias(other))
    far = near.join(vec("src", "a"), "src").join(vec("dst", "b"), "dst").select("src", "dst", vx.cosine("a", "b").alias("sim"))
    scored = top.withColumn("score", F.col("sim") * 1.5).select("src", "dst", "score").unionByName(far.withColumn("score", F.col("sim")).select("src", "dst", "score")).withColumn("score", F.round("score", 9))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))).where("rank <= 10")
    labels = base.select("id", "label")
    per_label = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    gold = q.select(F.col("id").alias("src"), "label").join(F.broadcast(per_label), "label")
    judged = ranked.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("found")), "dst").join(gold, "src").withColumn("good", (F.col("found") == F.col("label")).cast("int"))
    return judged.groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), F.max("good").alias("hit"), F.round(F.sum("good") / F.first("n_gold"), 6).alias("recall"), F.round(F.coalesce(1 / F.min(F.when(F.col("good") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr")
    )
