"""Ranked-list evaluation and run comparison."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.operators import evaluate as ev
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.operators import lexical as lx
from lattica.plans.vector_queries import _base, _features, knn_edges
from lattica.sources.tables import table

# Queries are the vectors with vec_id % 10 = 0, gold the others of their label; rk is the plain list, gr one-hop graph candidates.
EV = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v,b.v) AS sim FROM e a, e b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM pr QUALIFY rank <= 20),
und AS (SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM nn WHERE rank <= 10 AND sim >= 0.3), un AS (SELECT a AS src, b AS dst FROM und UNION SELECT b, a FROM und),
rk AS (SELECT src AS query, dst AS id, rank, sim FROM nn WHERE src % 10 = 0),
gold AS (SELECT q.vec_id AS query, x.vec_id AS id FROM e q JOIN e x ON x.label = q.label AND x.vec_id <> q.vec_id WHERE q.vec_id % 10 = 0),
g0 AS (SELECT DISTINCT query, un.dst AS id FROM rk JOIN un ON un.src = rk.id WHERE rank <= 5 AND un.dst <> query AND NOT EXISTS (SELECT 1 FROM rk r2 WHERE r2.query = rk.query AND r2.id = un.dst AND r2.rank <= 5)),
gr AS (SELECT g0.query, g0.id, row_number() OVER (PARTITION BY g0.query ORDER BY round(pr.sim, 9) DESC, g0.id) AS rank FROM g0 JOIN pr ON pr.src = g0.query AND pr.dst = g0.id),
jd AS (SELECT rk.*, gold.id IS NOT NULL AS good FROM rk LEFT JOIN gold USING (query, id)), gn AS (SELECT query, count(*) AS n_gold FROM gold GROUP BY 1)"""


def _ranked(spark, sf_dir, k=20):
    base = _base(spark, sf_dir)
    found = knn.search(base.where("id % 10 = 0"), base, k)
    return found.select(F.col("src").alias("query"), F.col("dst").alias("id"), "rank", "sim")


def _gold(spark, sf_dir):
    base = _base(spark, sf_dir).select("id", "label")
    q = base.where("id % 10 = 0").select(F.col("id").alias("query"), "label")
    return q.join(base, "label").where("id <> query").select("query", "id")


def _graph(spark, sf_dir, ranked, first=5):
    """query, id, rank of one-hop neighbours of the first results, by similarity to the query."""
    from lattica.functions import vectors as vx

    edges = knn_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    seeds = ranked.where(F.col("rank") <= first).select("query", "id")
    near = g.one_hop(seeds, edges, ["query"]).where("id <> query")
    vec = _base(spark, sf_dir).select("id", "vector")
    sims = near.join(vec, "id").join(vec.select(F.col("id").alias("query"), F.col("vector").alias("q")), "query").select("query", "id", vx.cosine("q", "vector").alias("score"))
    return lx.top(sims, 1_000_000).select("query", "id", "rank")


@query(f"""WITH {EV} SELECT query, max((good AND rank <= 10)::INT) AS hit, round(count(*) FILTER (good AND rank <= 10) / any_value(n_gold)::DOUBLE, 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (good), 0)::DOUBLE, 6) AS mrr, round(coalesce(1.0 / min(rank) FILTER (good AND rank <= 10), 0)::DOUBLE, 6) AS mrr_k FROM jd JOIN gn USING (query) GROUP BY query""")
def a8_hit_recall_mrr(spark, sf_dir):
    m = ev.metrics(_ranked(spark, sf_dir), _gold(spark, sf_dir), 10)
    return m.select("query", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "mrr_k")])


@query(f"""WITH {EV}, twice AS (SELECT query, id, rank, good FROM jd UNION ALL SELECT query, id, rank + 1, good FROM jd WHERE rank % 2 = 0)
SELECT query, round(count(*) FILTER (good AND rank <= 10) / any_value(n_gold)::DOUBLE, 6) AS listed, round(count(DISTINCT id) FILTER (good AND rank <= 10) / any_value(n_gold)::DOUBLE, 6) AS deduplicated FROM twice JOIN gn USING (query) GROUP BY query""")
def a9_recall_forms(spark, sf_dir):
    r = g.settled(_ranked(spark, sf_dir))
    twice = r.unionByName(r.where("rank % 2 = 0").withColumn("rank", F.col("rank") + 1))
    gold = _gold(spark, sf_dir)
    a, b = ev.metrics(twice, gold, 10), ev.metrics(twice, gold, 10, distinct_hits=True)
    return a.select("query", F.round("recall", 6).alias("listed")).join(b.select("query", F.round("recall", 6).alias("deduplicated")), "query")


@query(f"WITH {EV}, f AS (SELECT query, min(rank) FILTER (good) AS first FROM jd GROUP BY 1) SELECT k, round((SELECT count(*) FROM f WHERE first <= k) / (SELECT count(*) FROM f)::DOUBLE, 6) AS accuracy FROM generate_series(1, 20) t(k)")
def a11_accuracy_curve(spark, sf_dir):
    return ev.accuracy_curve(_ranked(spark, sf_dir), _gold(spark, sf_dir), 20).select("k", F.round("accuracy", 6).alias("accuracy"))


_LISTS = """enh AS (SELECT query, id, rank FROM rk WHERE rank <= 5 UNION ALL SELECT query, id, rank + 5 FROM gr WHERE rank <= 5),
mm AS (SELECT 'baseline' AS run, k, query, count(*) FILTER (good AND rank <= k) / any_value(n_gold)::DOUBLE AS recall, max((good AND rank <= k)::INT) AS hit FROM jd JOIN gn USING (query), (VALUES (5), (10)) t(k) GROUP BY ALL
UNION ALL SELECT 'enhanced', k, query, count(gold.id) FILTER (rank <= k) / any_value(n_gold)::DOUBLE, coalesce(max((gold.id IS NOT NULL AND rank <= k)::INT), 0) FROM enh JOIN gn USING (query) LEFT JOIN gold USING (query, id), (VALUES (5), (10)) t(k) GROUP BY ALL)"""


def _enhanced(spark, sf_dir, ranked, half=5):
    grown = _graph(spark, sf_dir, ranked).where(F.col("rank") <= half).withColumn("rank", F.col("rank") + half)
    return ranked.where(F.col("rank") <= half).select("query", "id", "rank").unionByName(grown)


def _runs(spark, sf_dir):
    ranked, gold = g.settled(_ranked(spark, sf_dir)), g.settled(_gold(spark, sf_dir))
    lists = {"baseline": ranked.select("query", "id", "rank"), "enhanced": g.settled(_enhanced(spark, sf_dir, ranked))}
    parts = [ev.metrics(x, gold, k).select(F.lit(run).alias("run"), F.lit(k).alias("k"), "query", "recall", "hit") for run, x in lists.items() for k in (5, 10)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {EV}, {_LISTS}, av AS (SELECT k, avg(recall) FILTER (run = 'baseline') AS b, avg(recall) FILTER (run = 'enhanced') AS x, avg(hit) FILTER (run = 'baseline') AS hb, avg(hit) FILTER (run = 'enhanced') AS hx FROM mm GROUP BY k)
SELECT k, round(b, 6) AS baseline, round(x, 6) AS enhanced, round(x - b, 6) + 0.0 AS gain, round(hx - hb, 6) + 0.0 AS hit_gain FROM av""")
def a12_macro_averages(spark, sf_dir):
    p = _runs(spark, sf_dir).groupBy("k").pivot("run", ["baseline", "enhanced"]).agg(F.avg("recall").alias("r"), F.avg("hit").alias("h"))
    return p.select("k", F.round("baseline_r", 6).alias("baseline"), F.round("enhanced_r", 6).alias("enhanced"), (F.round(F.col("enhanced_r") - F.col("baseline_r"), 6) + F.lit(0.0)).alias("gain"), (F.round(F.col("enhanced_h") - F.col("baseline_h"), 6) + F.lit(0.0)).alias("hit_gain"))


# Agent lists of different lengths: the first query % 25 of the graph candidates and list.
_AGENT = """ag AS (SELECT query, list(id ORDER BY rank, id) FILTER (rank <= query % 25) AS agent FROM (SELECT query, id, rank FROM rk UNION ALL SELECT query, id, rank + 20 FROM gr) GROUP BY 1), tp AS (SELECT query, list(id ORDER BY rank) AS top FROM rk GROUP BY 1),
ls AS (SELECT query, coalesce(agent, []::BIGINT[]) AS agent, top, list_filter(top, lambda x: list_contains(coalesce(agent, []::BIGINT[]), x)) AS shared FROM tp JOIN ag USING (query))"""


def _agent_lists(spark, sf_dir):
    ranked = g.settled(_ranked(spark, sf_dir).select("query", "id", "rank"))
    every = ranked.unionByName(_graph(spark, sf_dir, ranked).withColumn("rank", F.col("rank") + 20))
    listed = lambda x, name: x.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l")).select("query", F.transform("l", lambda s: s["id"]).alias(name))
    agent = listed(every.where(F.col("rank") <= F.col("query") % 25), "agent")
    return listed(ranked, "top").join(agent, "query", "left").withColumn("agent", F.coalesce("agent", F.array().cast("array<bigint>")))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH {EV}, {_AGENT} SELECT query, array_to_string(CASE WHEN len(agent) = 0 THEN [] WHEN len(agent) < 10 THEN agent WHEN len(agent) < 500 THEN shared ELSE top END, ',') AS ids FROM ls")
def a13_candidate_policy(spark, sf_dir):
    return _agent_lists(spark, sf_dir).select("query", _joined(ev.candidate_policy(F.col("agent"), F.col("top"))).alias("ids"))


@query(f"WITH {EV}, {_AGENT} SELECT query, array_to_string(CASE WHEN len(agent) < 20 THEN agent WHEN len(shared) > 0 THEN shared ELSE top END, ',') AS ids FROM ls")
def a14_strict_policy(spark, sf_dir):
    return _agent_lists(spark, sf_dir).select("query", _joined(ev.strict_policy(F.col("agent"), F.col("top"))).alias("ids"))


@query(f"""WITH {EV}, {_AGENT}, h AS (SELECT ls.query, count(gold.id) AS hits FROM (SELECT query, unnest(agent) AS id FROM ls) u RIGHT JOIN ls ON ls.query = u.query LEFT JOIN gold ON gold.query = u.query AND gold.id = u.id GROUP BY 1), t AS (SELECT query, count(*) FILTER (good) AS hits FROM jd GROUP BY 1),
c AS (SELECT ls.query, CASE WHEN len(agent) < 10 THEN '<10' WHEN len(agent) < 500 THEN '10-499' ELSE '>=500' END AS bucket, h.hits / n_gold::DOUBLE AS a, t.hits / n_gold::DOUBLE AS b FROM ls JOIN h USING (query) JOIN t USING (query) JOIN gn USING (query))
SELECT bucket, count(*) AS n, round(avg(a), 6) AS agent, round(avg(b), 6) AS top, count(*) FILTER (a > b + 1e-9) AS improved, count(*) FILTER (a < b - 1e-9) AS worsened, count(*) FILTER (abs(a - b) <= 1e-9) AS same FROM c GROUP BY bucket""")
def a15_bucketed_means(spark, sf_dir):
    lists, gold = g.settled(_agent_lists(spark, sf_dir)), g.settled(_gold(spark, sf_dir))
    share = lambda c, name: ev.metrics(lists.select("query", F.posexplode(c).alias("p", "id")).select("query", "id", (F.col("p") + 1).alias("rank")), gold, 1 << 30).select("query", F.col("recall").alias(name))
    rows = lists.select("query", ev.bucket(F.size("agent")).alias("bucket")).join(share("agent", "a"), "query").join(share("top", "b"), "query")
    d = F.col("a") - F.col("b")
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("agent"), F.round(F.avg("b"), 6).alias("top"), F.count_if(d > ev.TOLERANCE).alias("improved"), F.count_if(d < -ev.TOLERANCE).alias("worsened"), F.count_if(F.abs(d) <= ev.TOLERANCE).alias("same")
    )


_FIRSTS = "fl AS (SELECT gn.query, (SELECT min(rank) FROM jd WHERE jd.query = gn.query AND good) AS csv, (SELECT min(gr.rank) FROM gr JOIN gold USING (query, id) WHERE gr.query = gn.query) AS graph FROM gn)"


def _firsts(spark, sf_dir):
    ranked, gold = g.settled(_ranked(spark, sf_dir).select("query", "id", "rank")), g.settled(_gold(spark, sf_dir))
    grown = _graph(spark, sf_dir, ranked)
    return g.settled(ev.first_gold(ranked, gold).withColumnRenamed("first", "csv").join(ev.first_gold(grown, gold).withColumnRenamed("first", "graph"), "query"))


@query(f"""WITH {EV}, {_FIRSTS}, s AS (SELECT CASE WHEN coalesce(graph <= 5, false) AND coalesce(csv <= 1, false) THEN 'both_win' WHEN coalesce(graph <= 5, false) THEN 'graph_wins' WHEN coalesce(csv <= 1, false) THEN 'csv_wins' ELSE 'both_lose' END AS scenario FROM fl)
SELECT scenario, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 6)::DOUBLE AS percent FROM s GROUP BY 1""")
def a16_scenarios(spark, sf_dir):
    f = _firsts(spark, sf_dir)
    s = f.select(ev.scenario(F.coalesce(F.col("graph") <= 5, F.lit(False)), F.coalesce(F.col("csv") <= 1, F.lit(False))).alias("scenario")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))  # four rows


SETTINGS = [(c, x) for c in (1, 2, 5, 10) for x in (1, 3, 5)]
_SETTINGS = ", ".join(f"({c}, {x})" for c, x in SETTINGS)
_SWEEP = f"""sw AS (SELECT csv_k, graph_k, query, coalesce(csv <= csv_k, false) AS c, coalesce(csv <= csv_k, false) OR coalesce(graph <= graph_k, false) AS w FROM fl, (VALUES {_SETTINGS}) t(csv_k, graph_k)),
sa AS (SELECT csv_k, graph_k, avg(c::INT) AS csv_only, avg(w::INT) AS with_graph FROM sw GROUP BY ALL)"""


def _sweep(spark, sf_dir):
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("csv_k"), F.lit(x).alias("graph_k")) for c, x in SETTINGS]))
    f = _firsts(spark, sf_dir).select("query", "csv", "graph", t.alias("t")).select("query", "csv", "graph", "t.*")
    c = F.coalesce(F.col("csv") <= F.col("csv_k"), F.lit(False))
    return f.select("csv_k", "graph_k", "query", c.alias("c"), (c | F.coalesce(F.col("graph") <= F.col("graph_k"), F.lit(False))).alias("w"))


def _sweep_means(spark, sf_dir):
    return _sweep(spark, sf_dir).groupBy("csv_k", "graph_k").agg(F.avg(F.col("c").cast("int")).alias("csv_only"), F.avg(F.col("w").cast("int")).alias("with_graph"))


@query(f"WITH {EV}, {_FIRSTS}, {_SWEEP} SELECT csv_k, graph_k, round(csv_only, 6) AS csv_only, round(with_graph, 6) AS with_graph, round(with_graph - csv_only, 6) AS improvement FROM sa")
def a17_k_sweep(spark, sf_dir):
    s = _sweep_means(spark, sf_dir)
    return s.select("csv_k", "graph_k", F.round("csv_only", 6).alias("csv_only"), F.round("with_graph", 6).alias("with_graph"), F.round(F.col("with_graph") - F.col("csv_only"), 6).alias("improvement"))


FT = """f AS (SELECT vec_id AS id, 'head' AS feature, embedding[1:32]::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id, 'tail', embedding[33:64]::DOUBLE[] FROM embeddings),
fp AS (SELECT x.id AS query, y.id AS id, x.feature, list_cosine_similarity(x.v, y.v) AS sim FROM f x JOIN f y ON x.feature = y.feature AND x.id <> y.id WHERE x.id % 10 = 0),
fn AS (SELECT *, row_number() OVER (PARTITION BY feature, query ORDER BY sim DESC, id) AS rank FROM fp QUALIFY rank <= 20),
lb AS (SELECT vec_id, label FROM embeddings), fg AS (SELECT fn.*, a.label = b.label AS good, b.label AS node_label, a.label AS query_label FROM fn JOIN lb a ON a.vec_id = query JOIN lb b ON b.vec_id = id)"""


def _feature_lists(spark, sf_dir):
    f = _features(spark, sf_dir)
    found = knn.search(f.where("id % 10 = 0"), f, 20, on=[("feature", "feature")]).select("feature", F.col("src").alias("query"), F.col("dst").alias("id"), "rank", "sim")
    labels = _base(spark, sf_dir).select("id", "label")
    rows = found.join(labels.withColumnRenamed("label", "node_label"), "id").join(labels.select(F.col("id").alias("query"), F.col("label").alias("query_label")), "query")
    return g.settled(rows.withColumn("good", F.col("node_label") == F.col("query_label")))


@query(f"""WITH {FT}, m AS (SELECT query, id, count(*) AS k FROM fn GROUP BY ALL)
SELECT feature, count(*) FILTER (good) AS gold_found, count(*) FILTER (good AND rank <= 5) AS gold_in_top, count(*) FILTER (good AND k = 1) AS only_here, count(*) FILTER (k > 1) AS shared FROM fg JOIN m USING (query, id) GROUP BY feature""")
def a18_feature_contribution(spark, sf_dir):
    f = _feature_lists(spark, sf_dir)
    m = f.groupBy("query", "id").agg(F.count(F.lit(1)).alias("k"))
    good = F.col("good")
    return f.join(m, ["query", "id"]).groupBy("feature").agg(F.count_if(good).alias("gold_found"), F.count_if(good & (F.col("rank") <= 5)).alias("gold_in_top"), F.count_if(good & (F.col("k") == 1)).alias("only_here"), F.count_if(F.col("k") > 1).alias("shared"))


@query(f"WITH {FT} SELECT a.feature AS x, b.feature AS y, count(*) AS common, count(*) FILTER (a.good) AS common_gold FROM fg a JOIN fg b USING (query, id) GROUP BY ALL")
def a19_feature_overlap(spark, sf_dir):
    f = _feature_lists(spark, sf_dir)
    a, b = f.select("query", "id", F.col("feature").alias("x"), "good"), f.select("query", "id", F.col("feature").alias("y"))
    return a.join(b, ["query", "id"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("common"), F.count_if("good").alias("common_gold"))


@query(f"WITH {FT} SELECT query, round(avg((node_label % 2 <> query_label % 2)::INT), 6) AS cross_share, count(DISTINCT node_label) AS n_types FROM fg GROUP BY query")
def a20_cross_type_share(spark, sf_dir):
    f = _feature_lists(spark, sf_dir)
    return f.groupBy("query").agg(F.round(F.avg((F.col("node_label") % 2 != F.col("query_label") % 2).cast("int")), 6).alias("cross_share"), F.countDistinct("node_label").alias("n_types"))


@query(f"WITH {EV}, t AS (SELECT query, id, CASE WHEN id < 100 THEN 'low' WHEN id < 300 THEN 'middle' ELSE 'high' END AS kind FROM gold) SELECT kind, count(*) AS n, count(DISTINCT query) AS n_queries, (SELECT count(*) FROM (SELECT query FROM t GROUP BY query HAVING count(DISTINCT kind) > 1)) AS mixed FROM t GROUP BY kind")
def a21_gold_types(spark, sf_dir):
    kind = F.when(F.col("id") < 100, "low").when(F.col("id") < 300, "middle").otherwise("high")
    t = _gold(spark, sf_dir).withColumn("kind", kind)
    mixed = t.groupBy("query").agg(F.countDistinct("kind").alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed"))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("n_queries")).crossJoin(F.broadcast(mixed))


@query("""SELECT source, lang, count(*) AS n, round(avg(length(text)), 6) AS mean_length, min(length(text)) AS shortest, max(length(text)) AS longest, count(*) FILTER (lower(text) LIKE '%license%') AS tagged FROM documents GROUP BY source, lang""")
def a22_dataset_profile(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.count_if(F.contains(F.lower("text"), F.lit("license"))).alias("tagged"))


_MISS = "ms AS (SELECT gold.query, gold.id, EXISTS (SELECT 1 FROM rk WHERE rk.query = gold.query AND rk.id = gold.id AND rank <= 5) AS listed, EXISTS (SELECT 1 FROM gr WHERE gr.query = gold.query AND gr.id = gold.id) AS grown, EXISTS (SELECT 1 FROM un WHERE un.src = gold.id) AS in_graph, EXISTS (SELECT 1 FROM un JOIN rk ON rk.id = un.dst WHERE un.src = gold.id AND rk.query = gold.query) AS connected FROM gold)"


@query(f"WITH {EV}, {_MISS} SELECT CASE WHEN NOT in_graph THEN 'not_in_graph' WHEN NOT connected THEN 'not_connected' ELSE 'similarity_pruning' END AS reason, count(*) AS n, count(DISTINCT query) AS n_queries FROM ms WHERE NOT listed AND NOT grown GROUP BY 1")
def a24_miss_reasons(spark, sf_dir):
    ranked, gold = g.settled(_ranked(spark, sf_dir).select("query", "id", "rank")), _gold(spark, sf_dir)
    edges = g.settled(g.both_ways(knn_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    missed = gold.join(ranked.where("rank <= 5").select("query", "id"), ["query", "id"], "left_anti").join(_graph(spark, sf_dir, ranked).select("query", "id"), ["query", "id"], "left_anti")
    inside = edges.select(F.col("src").alias("id")).distinct().withColumn("in_graph", F.lit(True))
    linked = ranked.join(edges, ranked.id == edges.dst).select("query", F.col("src").alias("id")).distinct().withColumn("connected", F.lit(True))
    rows = missed.join(inside, "id", "left").join(linked, ["query", "id"], "left")
    reason = F.when(F.col("in_graph").isNull(), "not_in_graph").when(F.col("connected").isNull(), "not_connected").otherwise("similarity_pruning")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("n_queries"))


@query(f"""WITH {EV}, {_FIRSTS}, {_SWEEP}, lost AS (SELECT DISTINCT csv_k, query FROM sw WHERE NOT c), z AS (SELECT csv_k, count(*) AS n FROM lost GROUP BY 1)
SELECT a.csv_k AS x, b.csv_k AS y, count(*) AS common, round(100.0 * count(*) / least(any_value(za.n), any_value(zb.n)), 6)::DOUBLE AS overlap FROM lost a JOIN lost b USING (query) JOIN z za ON za.csv_k = a.csv_k JOIN z zb ON zb.csv_k = b.csv_k WHERE a.csv_k < b.csv_k GROUP BY ALL""")
def a25_scenario_overlap(spark, sf_dir):
    lost = g.settled(_sweep(spark, sf_dir).where(~F.col("c")).select("csv_k", "query").distinct())
    z = lost.groupBy("csv_k").agg(F.count(F.lit(1)).alias("n"))
    a, b = lost.join(z, "csv_k").toDF("x", "query", "nx"), lost.join(z, "csv_k").toDF("y", "query", "ny")
    both = a.join(b, "query").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("common"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    return both.select("x", "y", "common", F.round(100.0 * F.col("common") / F.least("nx", "ny"), 6).alias("overlap"))


@query(f"WITH {EV}, {_FIRSTS} SELECT k, round(avg(coalesce(csv <= k, false)::INT), 6) AS every, round(avg(coalesce(csv <= k, false)::INT) FILTER (csv IS NOT NULL), 6) AS without_missing FROM fl, (VALUES (1), (5), (10)) t(k) GROUP BY k")
def a26_accuracy_with_exclusions(spark, sf_dir):
    f = _firsts(spark, sf_dir).select("csv", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k"))
    hit = F.coalesce(F.col("csv") <= F.col("k"), F.lit(False)).cast("int")
    return f.groupBy("k").agg(F.round(F.avg(hit), 6).alias("every"), F.round(F.avg(F.when(F.col("csv").isNotNull(), hit)), 6).alias("without_missing"))


@query("""WITH d AS (SELECT length(text)::DOUBLE AS v, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT v, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM d GROUP BY v), t AS (SELECT sum(pos) AS n1, sum(neg) AS n0 FROM c),
w AS (SELECT *, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(neg) OVER (ORDER BY v DESC) AS fp FROM c, t)
SELECT any_value(n1)::BIGINT AS n_pos, any_value(n0)::BIGINT AS n_neg, sum(pos * (n0 - fp + 0.5 * neg))::DOUBLE AS u, round((sum(pos * (n0 - fp + 0.5 * neg)) / (any_value(n1) * any_value(n0)))::DOUBLE, 9) AS auc, round(max(tp / n1 - fp / n0)::DOUBLE, 9) AS youden, arg_max(v, (round((tp / n1 - fp / n0)::DOUBLE, 9), v)) AS threshold,
round(max(2 * tp / (tp + fp + n1))::DOUBLE, 9) AS best_f1, round((sum(tp / (tp + fp) * pos) / any_value(n1))::DOUBLE, 9) AS average_precision, round((sum(v * pos) / any_value(n1))::DOUBLE, 6) AS mean_pos, round((sum(v * neg) / any_value(n0))::DOUBLE, 6) AS mean_neg FROM w""")
def a27_group_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("v")).join(table(spark, sf_dir, "labels"), "doc_id")
    c = ev.group_comparison(d, "v", "quality")
    return c.select("n_pos", "n_neg", F.col("u").cast("double").alias("u"), "threshold", *[F.round(x, 9).alias(x) for x in ("auc", "youden", "best_f1", "average_precision")], *[F.round(x, 6).alias(x) for x in ("mean_pos", "mean_neg")])


@query(f"""WITH {EV}, w AS (SELECT query, max(rank) FILTER (good) AS worst FROM jd GROUP BY 1) SELECT query, worst::BIGINT AS worst, count(*) FILTER (NOT good AND rank < worst) AS outranking, round(avg(sim) FILTER (good), 6) AS gold_mean, round(avg(sim) FILTER (NOT good AND rank <= 10), 6) AS other_mean FROM jd JOIN w USING (query) WHERE worst IS NOT NULL GROUP BY query, worst""")
def a28_ranking_factors(spark, sf_dir):
    j = g.settled(ev.judged(_ranked(spark, sf_dir), _gold(spark, sf_dir)))
    worst = j.where("good").groupBy("query").agg(F.max("rank").alias("worst"))
    good = F.col("good")
    return j.join(worst, "query").groupBy("query", "worst").agg(F.count_if(~good & (F.col("rank") < F.col("worst"))).alias("outranking"), F.round(F.avg(F.when(good, F.col("sim"))), 6).alias("gold_mean"), F.round(F.avg(F.when(~good & (F.col("rank") <= 10), F.col("sim"))), 6).alias("other_mean"))


@query(f"WITH {EV}, {_FIRSTS}, {_SWEEP} SELECT graph_k, round(avg(with_graph - csv_only), 6) AS mean, round(stddev_samp(with_graph - csv_only), 6) AS std, count(*) AS n, arg_max(csv_k, (round(with_graph - csv_only, 9), -csv_k)) AS best_csv_k FROM sa GROUP BY graph_k")
def a30_improvement_by_k(spark, sf_dir):
    d = F.col("with_graph") - F.col("csv_only")
    return _sweep_means(spark, sf_dir).groupBy("graph_k").agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"), F.count(F.lit(1)).alias("n"), F.max_by("csv_k", F.struct(F.round(d, 9), -F.col("csv_k"))).alias("best_csv_k"))


@query(f"WITH {EV}, {_FIRSTS} SELECT count(*) AS n, count(*) FILTER (csv IS NOT NULL) AS found, round(count(*) FILTER (csv IS NOT NULL) / count(*)::DOUBLE, 6) AS success, round(avg(csv), 6) AS mean_rank, min(csv)::BIGINT AS best_rank, max(csv)::BIGINT AS worst_rank, count(*) FILTER (csv <= 5) AS top5, count(*) FILTER (csv <= 10) AS top10, count(*) FILTER (csv <= 15) AS top15 FROM fl")
def a32_run_statistics(spark, sf_dir):
    c = F.col("csv")
    return _firsts(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("found"), F.round(F.count(c) / F.count(F.lit(1)), 6).alias("success"), F.round(F.avg(c), 6).alias("mean_rank"), F.min(c).cast("long").alias("best_rank"), F.max(c).cast("long").alias("worst_rank"),
        *[F.count_if(c <= k).alias(f"top{k}") for k in (5, 10, 15)],
    )


@query(f"""WITH {EV}, x AS (SELECT jd.*, label % 2 = 0 AS doc FROM jd JOIN e ON vec_id = id) SELECT CASE WHEN doc THEN 'document' ELSE 'table' END AS kind, count(*) FILTER (good) AS n_gold, count(*) FILTER (NOT good) AS n_other, round(avg(sim) FILTER (good), 6) AS gold_mean, round(avg(sim) FILTER (NOT good), 6) AS other_mean, round(CASE WHEN avg(sim) FILTER (NOT good) <> 0 THEN avg(sim) FILTER (good) / avg(sim) FILTER (NOT good) END, 6) AS ratio FROM x GROUP BY doc""")
def a33_outranking_summary(spark, sf_dir):
    j = ev.judged(_ranked(spark, sf_dir), _gold(spark, sf_dir)).join(_base(spark, sf_dir).select("id", "label"), "id")
    good = F.col("good")
    a, b = F.avg(F.when(good, F.col("sim"))), F.avg(F.when(~good, F.col("sim")))
    return j.groupBy(F.when(F.col("label") % 2 == 0, "document").otherwise("table").alias("kind")).agg(F.count_if(good).alias("n_gold"), F.count_if(~good).alias("n_other"), F.round(a, 6).alias("gold_mean"), F.round(b, 6).alias("other_mean"), F.round(F.try_divide(a, b), 6).alias("ratio"))


@query(f"WITH {EV}, {_FIRSTS}, {_SWEEP} SELECT query, count(*) FILTER (w AND NOT c) AS enhanced, count(*) FILTER (c) AS csv_successes, count(*) FILTER (w) AS graph_successes FROM sw GROUP BY query")
def a34_question_counts(spark, sf_dir):
    c, w = F.col("c"), F.col("w")
    return _sweep(spark, sf_dir).groupBy("query").agg(F.count_if(w & ~c).alias("enhanced"), F.count_if(c).alias("csv_successes"), F.count_if(w).alias("graph_successes"))


@query(f"WITH {EV}, {_FIRSTS}, {_SWEEP} SELECT csv_k, round(max(with_graph - csv_only) FILTER (graph_k = 1), 6) AS g1, round(max(with_graph - csv_only) FILTER (graph_k = 3), 6) AS g3, round(max(with_graph - csv_only) FILTER (graph_k = 5), 6) AS g5, round(max((with_graph - csv_only) / graph_k), 6) AS efficiency FROM sa GROUP BY csv_k")
def a35_improvement_matrix(spark, sf_dir):
    d = F.col("with_graph") - F.col("csv_only")
    s = g.settled(_sweep_means(spark, sf_dir))
    matrix = s.groupBy("csv_k").pivot("graph_k", [1, 3, 5]).agg(F.round(F.max(d), 6)).withColumnsRenamed({"1": "g1", "3": "g3", "5": "g5"})
    return matrix.join(s.groupBy("csv_k").agg(F.round(F.max(d / F.col("graph_k")), 6).alias("efficiency")), "csv_k")


@query(f"WITH {EV} SELECT query FROM gn WHERE NOT EXISTS (SELECT 1 FROM jd WHERE jd.query = gn.query AND good AND rank <= 10)")
def f7_without_easy_queries(spark, sf_dir):
    easy = ev.judged(_ranked(spark, sf_dir), _gold(spark, sf_dir)).where("good AND rank <= 10").select("query").distinct()
    return _gold(spark, sf_dir).select("query").distinct().join(easy, "query", "left_anti")


@query(f"WITH {EV}, n AS (SELECT rk.query, un.dst AS id, count(*) AS appearances FROM rk JOIN un ON un.src = rk.id WHERE rank <= 9 GROUP BY ALL) SELECT * FROM n WHERE appearances >= greatest(1, 9 // 3)")
def f14_frequent_neighbours(spark, sf_dir):
    edges = g.both_ways(knn_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    r = _ranked(spark, sf_dir).where("rank <= 9")
    n = r.join(edges, r.id == edges.src).groupBy("query", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("appearances"))
    return n.where(F.col("appearances") >= max(1, 9 // 3))


@query(f"""WITH {EV}, en AS (SELECT query, id FROM rk WHERE rank <= 5 UNION SELECT query, id FROM gr WHERE rank <= 5), m AS (SELECT gn.query, (SELECT count(*) FROM jd WHERE jd.query = gn.query AND good AND rank <= 5) AS b5, (SELECT count(*) FROM jd WHERE jd.query = gn.query AND good AND rank <= 10) AS b10, (SELECT count(*) FROM en JOIN gold USING (query, id) WHERE en.query = gn.query) AS x, n_gold FROM gn)
SELECT round(avg(b5 / n_gold::DOUBLE), 6) AS baseline_k, round(avg(b10 / n_gold::DOUBLE), 6) AS baseline_2k, round(avg(x / n_gold::DOUBLE), 6) AS enhanced_2k FROM m""")
def h10_doubled_lists(spark, sf_dir):
    ranked, gold = g.settled(_ranked(spark, sf_dir).select("query", "id", "rank")), g.settled(_gold(spark, sf_dir))
    x = ev.metrics(_enhanced(spark, sf_dir, ranked), gold, 10, distinct_hits=True).select("query", F.col("recall").alias("x"))
    rows = ev.metrics(ranked, gold, 5).select("query", F.col("recall").alias("a")).join(ev.metrics(ranked, gold, 10).select("query", F.col("recall").alias("b")), "query").join(x, "query")
    return rows.agg(F.round(F.avg("a"), 6).alias("baseline_k"), F.round(F.avg("b"), 6).alias("baseline_2k"), F.round(F.avg("x"), 6).alias("enhanced_2k"))
