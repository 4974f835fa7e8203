"""Pair features, matching rules, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import text as tx
from lattica.functions import vectors as vx
from lattica.operators import chunking as ch
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.operators import pairs as pr
from lattica.plans.chunk_queries import KEYWORDS
from lattica.plans.vector_queries import _base, _features
from lattica.sources.tables import table

# Candidate pairs from neighbour lists of the head feature; metrics are the cosines of both features.
PM = """f AS (SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS h, embedding[33:64]::DOUBLE[] AS t FROM embeddings),
c0 AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.h, b.h) AS s FROM f a, f b WHERE a.vec_id <> b.vec_id),
c1 AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM c0 QUALIFY r <= 10)),
pm AS (SELECT a, b, CASE WHEN x.label % 2 = 0 AND y.label % 2 = 0 THEN 'doc-doc' WHEN x.label % 2 = 1 AND y.label % 2 = 1 THEN 'table-table' ELSE 'doc-table' END AS edge_type, round(greatest(0, list_cosine_similarity(x.h, y.h)), 9) AS content, round(greatest(0, list_cosine_similarity(x.t, y.t)), 9) AS topic, (x.label = y.label)::INT AS entities FROM c1 JOIN f x ON a = x.vec_id JOIN f y ON b = y.vec_id)"""


def pair_metrics(spark, sf_dir):
    f = _features(spark, sf_dir).where("feature = 'head'")
    found = knn.search(f, f, 10)
    pairs = found.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    v = F.col("vector")
    side = lambda i: _base(spark, sf_dir).select(F.col("id").alias("ab"[i]), F.slice(v, 1, 32).alias(f"h{i}"), F.slice(v, 33, 32).alias(f"t{i}"), F.col("label").alias(f"l{i}"))
    rows = pairs.join(side(0), "a").join(side(1), "b")
    even0, even1 = F.col("l0") % 2 == 0, F.col("l1") % 2 == 0
    kind = F.when(even0 & even1, "doc-doc").when(~even0 & ~even1, "table-table").otherwise("doc-table")
    return g.settled(rows.select("a", "b", kind.alias("edge_type"), F.round(vx.cosine_or_zero("h0", "h1"), 9).alias("content"), F.round(vx.cosine_or_zero("t0", "t1"), 9).alias("topic"), (F.col("l0") == F.col("l1")).cast("int").alias("entities")))


@query(f"WITH {PM} SELECT a, b, edge_type, round(content, 6) AS content, round(topic, 6) AS topic FROM pm")
def p1_content_and_topic(spark, sf_dir):
    return pair_metrics(spark, sf_dir).select("a", "b", "edge_type", F.round("content", 6).alias("content"), F.round("topic", 6).alias("topic"))


# Columns of a vector: its four quarters stand for the column descriptions of a table.
_QUARTERS = "[list_cosine_similarity({a}, y.v[1:16]), list_cosine_similarity({a}, y.v[17:32]), list_cosine_similarity({a}, y.v[33:48]), list_cosine_similarity({a}, y.v[49:64])]"
_COLS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def _quarter_pairs(spark, sf_dir, content):
    base = _base(spark, sf_dir)
    return pr.column_similarity(base.where("id % 100 = 0"), base, 4, 16, content)


@query(f"WITH {_COLS}, s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_reverse_sort({_QUARTERS.format(a='x.v[1:16]')})[1:3] AS s FROM e x, e y WHERE x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) SELECT a, b, round(list_sum(s) / 3, 6) AS similarity FROM s")
def p2_content_to_columns(spark, sf_dir):
    return _quarter_pairs(spark, sf_dir, content=True)


@query(f"WITH {_COLS}, s AS (SELECT x.vec_id AS a, y.vec_id AS b, [{', '.join(f'greatest(0, list_max({_QUARTERS.format(a=f'x.v[{1 + 16 * i}:{16 + 16 * i}]')}))' for i in range(4))}] AS s FROM e x, e y WHERE x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) SELECT a, b, round(list_sum(list_reverse_sort(s)[1:3]) / 3, 6) AS similarity FROM s")
def p3_columns_to_columns(spark, sf_dir):
    return _quarter_pairs(spark, sf_dir, content=False)


@query(f"WITH {PM} SELECT a, b, round(greatest(CASE edge_type WHEN 'doc-doc' THEN topic + content WHEN 'doc-table' THEN topic ELSE content END + entities, 0.01), 6) AS weight FROM pm")
def p8_composite_weight(spark, sf_dir):
    parts = {"doc-doc": ["topic", "content"], "doc-table": ["topic"], "table-table": ["content"]}
    return pair_metrics(spark, sf_dir).select("a", "b", F.round(pr.weight(F.col("edge_type"), parts, F.col("entities")), 6).alias("weight"))


@query(f"""WITH {KEYWORDS}, ka AS (SELECT doc_id, list(keyword) AS k FROM kw GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT p.a, p.b, len(list_intersect(x.k, y.k)) AS shared, round(len(list_intersect(x.k, y.k)) / (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k)))::DOUBLE, 6) AS jaccard FROM p JOIN ka x ON x.doc_id = p.a JOIN ka y ON y.doc_id = p.b""")
def p7_shared_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k = g.settled(ch.keywords(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list("keyword")).alias("k")))
    x, y = k.select(F.col("doc_id").alias("a"), F.col("k").alias("x")), k.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("k").alias("y"))
    return x.join(y, "a").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.round(pr.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(f"""WITH {PM}, x AS (SELECT a, b, edge_type, 'content' AS reason, 0 AS p FROM pm WHERE content > 0.5 UNION ALL SELECT a, b, edge_type, 'topic', 1 FROM pm WHERE topic > 0.3 UNION ALL SELECT a, b, edge_type, 'entity', 2 FROM pm WHERE entities > 0)
SELECT a, b, edge_type, reason, a||'_'||b AS edge_id FROM x QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY p) = 1""")
def p10_edges_with_reason(spark, sf_dir):
    m = pair_metrics(spark, sf_dir)
    parts = [(name, m.where(cond).select("a", "b", "edge_type")) for name, cond in (("content", "content > 0.5"), ("topic", "topic > 0.3"), ("entity", "entities > 0"))]
    return pr.first_reason(parts, ["a", "b"]).withColumn("edge_id", F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")))


@query(f"WITH {PM}, c AS (SELECT edge_type, quantile_cont(content, 0.9) AS c, quantile_cont(topic, 0.9) AS t FROM pm GROUP BY 1) SELECT a, b, edge_type, round(content, 6) AS content, round(topic, 6) AS topic FROM pm JOIN c USING (edge_type) WHERE content > c AND topic > t")
def f5_outliers(spark, sf_dir):
    return pr.outliers(pair_metrics(spark, sf_dir), "edge_type", ["content", "topic"], 0.9).select("a", "b", "edge_type", F.round("content", 6).alias("content"), F.round("topic", 6).alias("topic"))


@query(f"WITH {PM}, c AS (SELECT edge_type, quantile_cont(topic, 0.99) AS t FROM pm GROUP BY 1) SELECT a, b, edge_type, round(topic, 6) AS topic, x.label AS label_a, y.label AS label_b, CASE edge_type WHEN 'table-table' THEN 'columns' WHEN 'doc-doc' THEN 'topics' ELSE 'columns and topic' END AS context FROM pm JOIN c USING (edge_type) JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id WHERE topic > t")
def f12_outlier_rows(spark, sf_dir):
    o = pr.outliers(pair_metrics(spark, sf_dir), "edge_type", ["topic"], 0.99)
    labels = _base(spark, sf_dir).select("id", "label")
    rows = o.join(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("label_b")), "b")
    context = F.when(F.col("edge_type") == "table-table", "columns").when(F.col("edge_type") == "doc-doc", "topics").otherwise("columns and topic")
    return rows.select("a", "b", "edge_type", F.round("topic", 6).alias("topic"), "label_a", "label_b", context.alias("context"))


@query(f"WITH {PM} SELECT edge_type, count(*) AS n, round(avg(content), 6) AS mean, round(stddev_pop(content), 6) AS std, min(content) AS least, max(content) AS most, round(median(content), 6) AS med, count(*) FILTER (content < 0.2) AS b0, count(*) FILTER (content >= 0.2 AND content < 0.4) AS b1, count(*) FILTER (content >= 0.4 AND content < 0.6) AS b2, count(*) FILTER (content >= 0.6 AND content < 0.8) AS b3, count(*) FILTER (content >= 0.8) AS b4 FROM pm GROUP BY edge_type")
def a3_similarity_distribution(spark, sf_dir):
    c = F.col("content")
    bins = [F.count_if((c >= lo) & (c < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate([(-9.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 9.0)])]
    return pair_metrics(spark, sf_dir).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("med"), *bins)


_R = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
_CORR = " UNION ALL ".join(f"SELECT edge_type, '{x}' AS x, '{y}' AS y, round({_R.format(x=x, y=y)}, 6) AS r, coalesce(abs({_R.format(x=x, y=y)}) > 0.7, false) AS strong FROM m GROUP BY edge_type" for x, y in (("content", "topic"), ("content", "entities"), ("topic", "entities")))


@query(f"WITH {PM}, m AS (SELECT edge_type, content, topic, entities::DOUBLE AS entities FROM pm) {_CORR}")
def a4_correlations(spark, sf_dir):
    m = pair_metrics(spark, sf_dir).withColumn("entities", F.col("entities").cast("double"))
    return pr.correlations(m, "edge_type", ["content", "topic", "entities"]).select("edge_type", "x", "y", F.round("r", 6).alias("r"), F.coalesce(F.abs("r") > 0.7, F.lit(False)).alias("strong"))


_DESC = "count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS least, round(quantile_cont({m}, 0.25), 6) AS q25, round(quantile_cont({m}, 0.5), 6) AS q50, round(quantile_cont({m}, 0.75), 6) AS q75, round(max({m}), 6) AS most"


@query(f"WITH {PM} SELECT edge_type, 'content' AS metric, {_DESC.format(m='content')} FROM pm GROUP BY 1 UNION ALL SELECT edge_type, 'topic', {_DESC.format(m='topic')} FROM pm GROUP BY 1")
def a5_described(spark, sf_dir):
    d = pr.described(pair_metrics(spark, sf_dir), "edge_type", ["content", "topic"])
    return d.select("edge_type", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most")])


@query(f"WITH {PM} SELECT edge_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pm), 6)::DOUBLE AS percent, round(avg(content), 6) AS content, round(avg(topic), 6) AS topic, round(avg(entities), 6) AS entities FROM pm GROUP BY 1")
def a6_means_by_type(spark, sf_dir):
    m = pair_metrics(spark, sf_dir)
    total = m.agg(F.count(F.lit(1)).alias("total"))
    means = m.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("content", "topic", "entities")])
    return means.crossJoin(F.broadcast(total)).select("edge_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), "content", "topic", "entities")


@query("SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {p / 100}) AS p{p}" for p in (20, 25, 75, 80, 90, 95, 99)) + " FROM lineitem")
def a7_exact_quantiles(spark, sf_dir):
    ps = (20, 25, 75, 80, 90, 95, 99)
    one = table(spark, sf_dir, "lineitem").agg(F.percentile("l_extendedprice", F.array(*[F.lit(p / 100) for p in ps])).alias("p"))
    return one.select(*[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(ps)])


_NAME = r"regexp_replace(regexp_replace(trim(lower({c})), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g')"
_CHARS = "list_distinct(string_split(replace({x}, ' ', ''), ''))"


@query(f"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, {_NAME.format(c="a.p_name||' '||a.p_type")} AS x, {_NAME.format(c="b.p_name||' '||b.p_type")} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT *, {_CHARS.format(x="x")} AS cx, {_CHARS.format(x="y")} AS cy FROM p)
SELECT a, b, round(0.7 * len(list_intersect(cx, cy)) / (len(cx) + len(cy) - len(list_intersect(cx, cy))) + 0.3 * least(length(x), length(y)) / greatest(length(x), length(y)), 6) AS similarity FROM q""")
def f6_name_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("n"))
    pairs = n.select(F.col("p_partkey").alias("a"), F.col("n").alias("x")).join(n.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("n").alias("y")), "a")
    return pairs.select("a", "b", F.round(tx.name_similarity("x", "y"), 6).alias("similarity"))


@query("SELECT doc_id, substr(coalesce(text, ''), 1, 200) AS short, substr(coalesce(text, ''), 1, 500) AS long FROM documents")
def f9_previews(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(t, 1, 200).alias("short"), F.substring(t, 1, 500).alias("long"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'o'||o_orderkey||',c'||o_custkey WHEN 1 THEN 'o'||o_orderkey WHEN 2 THEN 'o'||o_orderkey||',x' ELSE '' END AS items FROM orders""")
def f10_list_literals(spark, sf_dir):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    literal = F.when(kind == 0, F.concat(F.lit("['o"), o, F.lit("', 'c"), c, F.lit("']"))).when(kind == 1, F.concat(F.lit("o"), o)).when(kind == 2, F.concat(F.lit("\"['o"), o, F.lit("', 'x']\""))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.list_literal(literal), ",").alias("items"))


@query("""WITH x AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part) SELECT p_partkey, a AS answer, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS matches FROM x""")
def f11_normal_answers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.normal_answer("p_name").alias("answer"), tx.answers_match(F.col("p_name"), F.col("p_brand")).alias("matches"))


_ENT = "list_filter(string_split(lower(text), ' '), lambda w: length(w) BETWEEN 3 AND 6)"


def _names(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w).between(3, 6))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("names"))


def _neighbours(rows):
    a, b = rows.select(F.col("doc_id").alias("a"), F.col("names").alias("x")), rows.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("names").alias("y"))
    return a.join(b, "a")


@query()
def j16_fuzzy_entity_matches(spark, sf_dir):
    return _neighbours(_names(spark, sf_dir)).select("a", "b", pr.match_count("x", "y").alias("matches"))


@query()
def j17_fuzzy_event_matches(spark, sf_dir):
    """Greedy matches of event names (type and month) of users with neighbouring ids."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.concat_ws(" ", "event_type", F.date_format("ts", "MMMM")).alias("n"))
    names = e.groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("names"))
    return _neighbours(names).select("a", "b", pr.match_count("x", "y").alias("matches"))


_MAPS = """u AS (SELECT user_id, event_type, list_sort(list(DISTINCT date_part('month', ts)::BIGINT)) AS months FROM events GROUP BY ALL), p AS (SELECT a.user_id AS a, b.user_id AS b, a.event_type, a.months AS x, b.months AS y FROM u a JOIN u b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type)"""


@query(f"WITH {_MAPS} SELECT a, b, count(*) AS n_shared, round(avg(len(list_intersect(x, y)) / greatest(len(x), len(y), 1)::DOUBLE), 6) AS overlap, sum(len(list_distinct(list_concat(x, y))))::BIGINT AS merged FROM p GROUP BY a, b")
def j18_exact_entity_overlap(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set(F.month("ts"))).alias("months"))
    m = u.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "months"))).alias("m"))
    p = m.select(F.col("user_id").alias("a"), F.col("m").alias("x")).join(m.select((F.col("user_id") - 1).alias("a"), F.col("user_id").alias("b"), F.col("m").alias("y")), "a")
    keys = F.array_intersect(F.map_keys("x"), F.map_keys("y"))
    rates = F.transform(keys, lambda k: pr.overlap(F.element_at("x", k), F.element_at("y", k)))
    merged = F.map_values(pr.merged_attributes(F.col("x"), F.col("y")))
    n = F.size(keys)
    out = p.select("a", "b", n.cast("long").alias("n_shared"), F.round(F.aggregate(rates, F.lit(0.0), lambda s, r: s + r) / F.when(n > 0, n), 6).alias("overlap"), F.aggregate(merged, F.lit(0).cast("long"), lambda s, v: s + F.size(v)).alias("merged"))
    return out.where("n_shared > 0")


@query(f"""WITH n AS (SELECT doc_id, {_ENT} AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, unnest(a.w) AS x, b.w AS y FROM n a JOIN n b ON b.doc_id = a.doc_id + 1),
k AS (SELECT a, b, x, list_filter(y, lambda z: contains(z, x))[1] AS hit FROM p) SELECT a, b, count(*) FILTER (hit = x) AS exact, count(*) FILTER (hit <> x) AS partial FROM k GROUP BY a, b""")
def j19_first_matches(spark, sf_dir):
    n = _neighbours(_names(spark, sf_dir)).where(F.size("x") > 0)
    return n.select("a", "b", pr.first_match_counts("x", "y").alias("n")).select("a", "b", "n.exact", "n.partial")


@query(f"WITH n AS (SELECT doc_id, {_ENT} AS w FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, len(list_filter(a.w, lambda x: list_contains(b.w, x))) AS matches FROM n a JOIN n b ON b.doc_id = a.doc_id + 1")
def j20_equal_names(spark, sf_dir):
    return _neighbours(_names(spark, sf_dir)).select("a", "b", F.size(F.filter("x", lambda v: F.array_contains("y", v))).cast("long").alias("matches"))  # both sides are lower-case words


@query(f"WITH {PM} SELECT count(*) AS n_edges, count(*) FILTER (content >= 0.4) AS kept, (SELECT count(*) FROM (SELECT a AS id FROM pm WHERE content >= 0.4 UNION SELECT b FROM pm WHERE content >= 0.4)) AS n_nodes FROM pm")
def j7_edges_of_loaded_nodes(spark, sf_dir):
    m = pair_metrics(spark, sf_dir)
    kept = m.where("content >= 0.4")
    nodes = kept.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    inside = g.induced(kept.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes)
    return m.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(inside.agg(F.count(F.lit(1)).alias("kept"))).crossJoin(nodes.agg(F.count(F.lit(1)).alias("n_nodes")))


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part)
SELECT p_partkey, array_to_string(list_filter([p_name, p_brand, p_type], lambda v: length(v) > 2 AND contains(lower(p_name||' of '||p_type), lower(v)))[1:10], ',') AS refs FROM p""")
def j15_value_references(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(pr.references(F.array("p_name", "p_brand", "p_type"), F.concat_ws(" of ", "p_name", "p_type")), ",").alias("refs"))
