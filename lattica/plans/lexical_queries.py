"""Tokenisers, BM25, saturation scores and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import text as tx
from lattica.functions import vectors as vx
from lattica.operators import chunking as ch
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.operators import lexical as lx
from lattica.operators.sizes import small
from lattica.plans.chunk_queries import KEYWORDS, LIST
from lattica.sources.tables import table

SCORE_LIST = "['" + "','".join(tx.SCORE_STOPWORDS) + "']"
_W = r"[\p{L}\p{N}_]+"


def words_sql(t):
    return rf"regexp_extract_all(lower(coalesce({t},'')), '{_W}')"


def lexical_sql(t):
    return rf"list_filter({words_sql(t)}, lambda w: len(w) > 2 AND NOT list_contains({LIST}, w) AND regexp_full_match(w, '\p{{L}}+'))"


def plain_sql(t):
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({t},'')), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: len(w) > 2 AND NOT list_contains({SCORE_LIST}, w))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tokens(spark, sf_dir, tokeniser):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), tokeniser("text").alias("tokens"))


def _queries(spark, sf_dir, tokeniser):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), tokeniser("text").alias("tokens"))


def _token_stats(spark, sf_dir, tokeniser):
    return _tokens(spark, sf_dir, tokeniser).select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


def _token_sql(ws):
    return f"WITH t AS (SELECT doc_id, {ws} AS ws FROM documents) SELECT doc_id, len(ws) AS n, len(list_distinct(ws)) AS n_distinct, md5(array_to_string(ws, ' ')) AS digest FROM t"


@query(_token_sql(lexical_sql("text")))
def b1_lexical_tokens(spark, sf_dir):
    return _token_stats(spark, sf_dir, tx.lexical_words)


@query(_token_sql(plain_sql("text")))
def b2_plain_tokens(spark, sf_dir):
    return _token_stats(spark, sf_dir, tx.plain_words)


@query(_token_sql(words_sql("text")))
def b3_word_tokens(spark, sf_dir):
    return _token_stats(spark, sf_dir, tx.words)


def index_sql(ws_doc, ws_query):
    return f"""dt AS (SELECT doc_id AS id, {ws_doc} AS ws FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM dt) GROUP BY ALL),
ln AS (SELECT id, len(ws) AS length FROM dt), tot AS (SELECT count(*)::DOUBLE AS n_docs, avg(length) AS mean_length FROM ln), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf0 AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM dfr, tot),
qt AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({ws_query}) AS term FROM benchmark) GROUP BY ALL)"""


_PART = "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))"
BM25 = index_sql(lexical_sql("text"), lexical_sql("text")) + f""",
bm AS (SELECT query, id, sum(qf * {_PART}) AS score FROM qt JOIN tf USING (term) JOIN ln USING (id) JOIN idf0 USING (term), tot GROUP BY ALL)"""


def bm25(spark, sf_dir, floor_negative=False, tokeniser=tx.lexical_words):
    return lx.LexicalIndex(_tokens(spark, sf_dir, tokeniser), floor_negative).scores(_queries(spark, sf_dir, tokeniser))


@query(f"WITH {BM25} SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 20")
def b4_bm25(spark, sf_dir):
    return lx.top(bm25(spark, sf_dir), 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {index_sql(words_sql("text"), words_sql("text"))}, mean AS (SELECT avg(idf) AS m FROM idf0), idf1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf0, mean),
bm AS (SELECT query, id, sum(qf * {_PART}) AS score FROM qt JOIN tf USING (term) JOIN ln USING (id) JOIN idf1 USING (term), tot GROUP BY ALL)
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20""")
def b5_okapi(spark, sf_dir):
    return lx.top(bm25(spark, sf_dir, True, tx.words).where("score > 0"), 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


SATURATION = index_sql(plain_sql("text"), plain_sql("text")) + """,
sa AS (SELECT query, id, sum(tf / (tf + 1.0)) / sqrt(any_value(length)) AS score FROM qt JOIN tf USING (term) JOIN ln USING (id) GROUP BY ALL)"""


def saturation(spark, sf_dir):
    return lx.LexicalIndex(_tokens(spark, sf_dir, tx.plain_words)).saturation_scores(_queries(spark, sf_dir, tx.plain_words))


@query(f"WITH {SATURATION} SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM sa QUALIFY rank <= 20")
def b6_saturation(spark, sf_dir):
    return lx.top(saturation(spark, sf_dir), 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 20) SELECT query, id, round(CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN score / max(score) OVER (PARTITION BY query) ELSE score END, 6) AS score FROM t")
def b7_max_normalised(spark, sf_dir):
    return lx.max_normalised(lx.top(bm25(spark, sf_dir), 20)).select("query", "id", F.round("score", 6).alias("score"))


# Dense side of the hybrid rules: hashed embeddings of queries and documents.
_EMB = """{name}c AS (SELECT {key} AS k, ('0x'||substr(md5(t),1,4))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({ws}) AS t FROM {table}) GROUP BY ALL),
{name} AS (SELECT k, b, n / sqrt(sum(n*n) OVER (PARTITION BY k)) AS x FROM {name}c)"""
DENSE = _EMB.format(name="dv", key="doc_id", ws=words_sql("text"), table="documents") + ",\n" + _EMB.format(name="qv", key="item_id", ws=words_sql("text"), table="benchmark") + """,
co AS (SELECT q.k AS query, d.k AS id, sum(q.x * d.x) AS c FROM qv q JOIN dv d USING (b) GROUP BY ALL)"""


def _hashed(tokens, key):
    """id, vector: hashed embeddings of the rows that have tokens."""
    return tokens.where(F.size("tokens") > 0).select(F.col(key).alias("id"), vx.hashed_vector("tokens").alias("vector"))


def dense_top(spark, sf_dir, k):
    """query, id, score, rank: the k documents nearest to each benchmark item by cosine of their hashed embeddings. Rows with no bucket in common (cosine 0) don't count."""
    d, q = _hashed(_tokens(spark, sf_dir, tx.words), "id"), _hashed(_queries(spark, sf_dir, tx.words), "query")
    found = knn.near(q, d, k, exclude=False, slack=1e-9).where("sim > 0")
    return lx.top(found.select(F.col("src").alias("query"), F.col("dst").alias("id"), F.col("sim").alias("score")), k)


def dense_of(spark, sf_dir, pairs):
    """query, id, score of given pairs only, where the cosine is positive."""
    d, q = _hashed(_tokens(spark, sf_dir, tx.words), "id"), _hashed(_queries(spark, sf_dir, tx.words), "query")
    asked = d.join(small(pairs.select("id").distinct(), 24), "id", "left_semi")
    rows = pairs.select("query", "id").join(asked.withColumnRenamed("vector", "x"), "id").join(small(q.select(F.col("id").alias("query"), F.col("vector").alias("y")), 600), "query")
    return rows.select("query", "id", vx.cosine("x", "y").alias("score")).where("score > 0")


def _out(scores, k=20):
    return lx.top(scores, k).select("query", "id", F.round("score", 6).alias("score"), "rank")


def _out_sql(rel, k=20):
    return f"SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM {rel} QUALIFY rank <= {k}"


_TOPS = """nt AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co QUALIFY rank <= {k}),
xt AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= {k})"""


def _tops(spark, sf_dir, k):
    near = dense_top(spark, sf_dir, k)
    return near, lx.top(bm25(spark, sf_dir), k)


@query(f"""WITH {BM25}, {DENSE}, {_TOPS.format(k=50)}, nx AS (SELECT query, id, CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN score / max(score) OVER (PARTITION BY query) ELSE score END AS s FROM xt),
h AS (SELECT query, id, 0.5 * coalesce(c, 0) + 0.5 * coalesce(s, 0) AS score FROM nt FULL JOIN nx USING (query, id)) {_out_sql("h")}""")
def h1_hybrid_even(spark, sf_dir):
    near, lexical = _tops(spark, sf_dir, 50)
    return _out(lx.blended(near, lx.max_normalised(lexical), 0.5))


@query(f"""WITH {SATURATION}, {DENSE}, ca AS (SELECT query, id FROM sa QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 50),
h AS (SELECT query, id, CASE WHEN c IS NULL THEN 0 ELSE 0.4 * greatest(0, c) + 0.6 * sa.score END AS score FROM ca JOIN sa USING (query, id) LEFT JOIN co USING (query, id)) {_out_sql("h")}""")
def h2_hybrid_saturation(spark, sf_dir):
    lexical = saturation(spark, sf_dir)
    candidates = g.settled(lx.top(lexical, 50).select("query", "id", "score"))
    lexical = candidates
    near = dense_of(spark, sf_dir, candidates)
    return _out(lx.blended_left(candidates, near, lexical, 0.4, needs_near=True))


@query(f"""WITH {BM25}, {DENSE}, {_TOPS.format(k=100)}, near AS (SELECT query, id, 1 / (1 + 2 - 2 * c) AS n FROM nt), lex AS (SELECT query, id, score / max(score) OVER (PARTITION BY query) AS s FROM bm WHERE score > 0),
h AS (SELECT query, id, CASE WHEN n IS NOT NULL AND s IS NOT NULL THEN 1.5 ELSE 1.0 END * (0.5 * coalesce(n, 0) + 0.5 * coalesce(s, 0)) AS score FROM near FULL JOIN lex USING (query, id)) {_out_sql("h", 50)}""")
def h4_service_hybrid(spark, sf_dir):
    near = dense_top(spark, sf_dir, 100).withColumn("score", 1 / (1 + 2 - 2 * F.col("score")))
    lexical = lx.max_normalised(bm25(spark, sf_dir).where("score > 0"))
    return _out(lx.blended(near, lexical, 0.5, lx.BOOST), 50)


# Links for one-hop expansion: documents of one source follow one another.
LINKS = "lk0 AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents), lk AS (SELECT a AS src, b AS dst FROM lk0 WHERE b IS NOT NULL UNION SELECT b, a FROM lk0 WHERE b IS NOT NULL)"


def links(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("src"), F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("dst"))
    return rows.where("dst IS NOT NULL")


@query(f"""WITH {BM25}, {DENSE}, {_TOPS.format(k=100)},
n1 AS (SELECT query, id, 2 - 2 * c AS distance, rank, quantile_cont(2 - 2 * c, 0.2) OVER (PARTITION BY query) AS cut FROM nt),
xc AS (SELECT query, quantile_cont(score, 0.8) AS cut FROM xt WHERE score > 0 GROUP BY 1), x1 AS (SELECT xt.*, cut FROM xt LEFT JOIN xc USING (query)),
bo AS (SELECT query, id, CASE WHEN distance <= n1.cut + 1e-12 AND coalesce(x1.score >= x1.cut - 1e-12, false) THEN 1 ELSE 2 END AS p FROM n1 JOIN x1 USING (query, id)),
al AS (SELECT * FROM bo UNION SELECT query, id, 2 FROM bo UNION SELECT query, id, 3 FROM nt WHERE rank <= 10 UNION SELECT query, id, 3 FROM xt WHERE rank <= 10),
cm AS (SELECT DISTINCT query, id FROM (SELECT *, min(p) OVER (PARTITION BY query) AS b FROM al) WHERE p = b), {LINKS},
ex AS (SELECT query, id, true AS common FROM cm UNION SELECT query, dst, false FROM cm JOIN lk ON id = src WHERE NOT EXISTS (SELECT 1 FROM cm c2 WHERE c2.query = cm.query AND c2.id = dst)),
mx AS (SELECT query, max(score) AS m FROM xt GROUP BY 1),
h AS (SELECT query, id, CASE WHEN common THEN 1.5 ELSE 1.0 END * (0.5 * coalesce(1 / (1 + 2 - 2 * c), 0) + 0.5 * coalesce(CASE WHEN m > 0 THEN xt.score / m ELSE xt.score END, 0)) AS score
FROM ex LEFT JOIN nt USING (query, id) LEFT JOIN xt USING (query, id) LEFT JOIN mx USING (query)) {_out_sql("h")}""")
def h5_graph_enhanced_retrieval(spark, sf_dir):
    near, lexical = (g.settled(x) for x in _tops(spark, sf_dir, 100))
    common = g.settled(lx.common_or_fallback(near.withColumn("distance", 2 - 2 * F.col("score")), lexical, 20))
    grown = g.one_hop(common, links(spark, sf_dir), ["query"])
    candidates = common.withColumn("boost", F.lit(lx.BOOST)).unionByName(grown.withColumn("boost", F.lit(1.0)))
    scored = lx.blended_left(candidates.select("query", "id"), near.withColumn("score", 1 / (1 + 2 - 2 * F.col("score"))), lx.max_normalised(lexical), 0.5)
    return _out(scored.join(candidates, ["query", "id"]).withColumn("score", F.col("score") * F.col("boost")))


@query(f"""WITH {KEYWORDS}, kq AS (SELECT item_id AS query, unnest(list_distinct(list_filter({words_sql("text")}, lambda w: len(w) > 2 AND NOT list_contains({LIST}, w)))) AS keyword FROM benchmark)
SELECT query, doc_id, count(*) AS matches FROM kq JOIN kw USING (keyword) GROUP BY ALL HAVING count(*) >= 2""")
def k7_keyword_search(spark, sf_dir):
    kw = ch.keywords(_docs(spark, sf_dir)).select("doc_id", "keyword")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(tx.content_words("text"))).alias("keyword"))
    return q.join(kw, "keyword").groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("matches")).where("matches >= 2")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j15_substring_join(spark, sf_dir):
    """Documents that hold a whole item: candidates share the item's longest word, so only those are compared in full."""
    items = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).select("item_id", F.col("text").alias("item"))
    found = items.withColumn("words", F.regexp_extract_all("item", F.lit(r"(?<=[^\p{L}])(\p{L}+)(?=[^\p{L}])"), F.lit(1)))
    longest = found.withColumn("word", F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"])
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    near = tokens.join(small(longest.where("word IS NOT NULL").select("item_id", "word"), 60), "word").select("item_id", "doc_id")
    keyed = near.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "item"))
    bare = longest.where("word IS NULL").select("item_id", "item").join(docs, F.contains("text", "item"))  # items without an inner word
    return keyed.select("item_id", "doc_id").unionByName(bare.select("item_id", "doc_id"))


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), 'build') QUALIFY row_number() OVER (ORDER BY c_custkey) <= 10")
def f13_search_box(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hit = F.contains(F.lower("c_name"), F.lit("42")) | F.contains(F.lower("c_mktsegment"), F.lit("build"))
    return c.where(hit).select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


@query(f"""WITH {BM25}, {DENSE}, t AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co QUALIFY rank <= 10),
h AS (SELECT t.query, t.id, 0.4 * c + 0.6 * coalesce(bm.score, 0) + 0.1 * (d.lang = 'en')::INT + 0.05 * (contains(lower(d.text), 'the'))::INT AS score FROM t JOIN documents d ON d.doc_id = t.id LEFT JOIN bm ON bm.query = t.query AND bm.id = t.id) {_out_sql("h", 10)}""")
def h3_hybrid_with_bonus(spark, sf_dir):
    near = dense_top(spark, sf_dir, 10)
    base = lx.blended_left(near.select("query", "id"), near, bm25(spark, sf_dir), 0.4)
    facts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("exact"), F.contains(F.lower("text"), F.lit("the")).cast("int").alias("partial"))
    return _out(base.join(facts, "id").withColumn("score", F.col("score") + lx.entity_bonus(F.col("exact"), F.col("partial"))).select("query", "id", "score"), 10)


@query(f"""WITH {DENSE}, t AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co QUALIFY rank <= 10), {LINKS},
p AS (SELECT t.query, lk.dst AS id, t.c FROM t JOIN lk ON lk.src = t.id),
n AS (SELECT query, id, count(*) AS appearances, max(c) AS best, avg(c) AS mean FROM p GROUP BY ALL), th AS (SELECT query, avg(mean) AS threshold FROM n GROUP BY 1)
SELECT query, id, appearances, round(best, 6) AS best, round(mean, 6) AS mean, round(threshold, 6) AS threshold FROM n JOIN th USING (query) """)
def h8_neighbour_scores(spark, sf_dir):
    """Neighbours of retrieved documents with how often, how near at best and on average; the threshold is the mean of the means."""
    near = dense_top(spark, sf_dir, 10)
    p = near.join(g.both_ways(links(spark, sf_dir)), near.id == F.col("src")).select("query", F.col("dst").alias("id"), "score")
    n = p.groupBy("query", "id").agg(F.count(F.lit(1)).alias("appearances"), F.max("score").alias("best"), F.avg("score").alias("mean"))
    th = n.groupBy("query").agg(F.avg("mean").alias("threshold"))
    return n.join(th, "query").select("query", "id", "appearances", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), F.round("threshold", 6).alias("threshold"))


def _expanded_sql(k0, extra):
    return f"""WITH {DENSE}, t AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co), {LINKS},
s AS (SELECT * FROM t WHERE rank <= {k0}), gr AS (SELECT DISTINCT s.query, lk.dst AS id FROM s JOIN lk ON lk.src = s.id WHERE NOT EXISTS (SELECT 1 FROM s s2 WHERE s2.query = s.query AND s2.id = lk.dst)),
gs AS (SELECT gr.query, gr.id, coalesce(c, 0) AS c FROM gr LEFT JOIN co USING (query, id)), gt AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) + {k0} AS rank FROM gs QUALIFY rank <= {k0 + extra})
SELECT query, id, rank, 'initial' AS origin FROM s UNION ALL SELECT query, id, rank, 'graph' FROM gt"""


@query(_expanded_sql(5, 5))
def h9_enhanced_list(spark, sf_dir):
    """The first k0 results, then the best graph candidates in the slots after them (5 and 5 for a list of 10)."""
    initial = g.settled(dense_top(spark, sf_dir, 5))
    grown = g.settled(g.one_hop(initial.select("query", "id"), links(spark, sf_dir), ["query"]))
    grown = grown.join(dense_of(spark, sf_dir, grown), ["query", "id"], "left").select("query", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    extra = lx.top(grown, 5).withColumn("rank", F.col("rank") + 5)
    cols = ["query", "id", "rank"]
    return initial.select(*cols, F.lit("initial").alias("origin")).unionByName(extra.select(*cols, F.lit("graph").alias("origin")))


@query(f"""WITH {DENSE}, t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co QUALIFY rank <= 10), {LINKS},
gr AS (SELECT DISTINCT t.query, lk.dst AS id FROM t JOIN lk ON lk.src = t.id WHERE NOT EXISTS (SELECT 1 FROM t s2 WHERE s2.query = t.query AND s2.id = lk.dst))
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS position FROM gr QUALIFY position <= 5""")
def h11_unranked_expansion(spark, sf_dir):
    found = dense_top(spark, sf_dir, 10).select("query", "id")
    grown = g.one_hop(found, links(spark, sf_dir), ["query"])
    return grown.withColumn("position", F.row_number().over(W.partitionBy("query").orderBy("id")).cast("long")).where("position <= 5")


@query(rf"""WITH qs AS (SELECT item_id AS query, unnest(list_filter(string_split(regexp_replace(text, '([.?!])[ \t\n\x0B\f\r]+', '\1'||chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sub, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.?!])[ \t\n\x0B\f\r]+', '\1'||chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) - 1 AS pos FROM benchmark),
parts AS (SELECT query, -1 AS pos, text AS t FROM (SELECT item_id AS query, text FROM benchmark) UNION ALL SELECT query, pos, trim(sub) FROM qs),
pc AS (SELECT query, pos, ('0x'||substr(md5(w),1,4))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT query, pos, unnest({words_sql("t")}) AS w FROM parts) GROUP BY ALL), pv AS (SELECT query, pos, b, n / sqrt(sum(n*n) OVER (PARTITION BY query, pos)) AS x FROM pc), {DENSE},
t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM co QUALIFY rank <= 10),
s AS (SELECT t.query, t.id, pv.pos, round(sum(pv.x * dv.x), 9) AS c FROM t JOIN pv ON pv.query = t.query JOIN dv ON dv.k = t.id AND dv.b = pv.b GROUP BY ALL)
SELECT query, id, round(max(c), 6) AS score, arg_min(pos, (-c, pos))::BIGINT AS winner FROM s GROUP BY query, id""")
def h7_best_part_of_question(spark, sf_dir):
    """Similarity of the whole question or its best sentence, whichever is greater; winner is the sentence, -1 the whole."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    subs = items.select("query", F.posexplode(tx.sentences("text")).alias("pos", "t"))
    parts = items.select("query", F.lit(-1).alias("pos"), F.col("text").alias("t")).unionByName(subs).select("query", "pos", tx.words("t").alias("tokens"))
    pv = vx.hashed_embedding(parts, ["query", "pos"], "tokens").withColumnRenamed("x", "y")
    dv = vx.hashed_embedding(_tokens(spark, sf_dir, tx.words), ["id"], "tokens")
    near = dense_top(spark, sf_dir, 10).select("query", "id")
    s = near.join(dv, "id").join(pv, ["query", "bucket"]).groupBy("query", "id", "pos").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("c"))
    return s.groupBy("query", "id").agg(F.round(F.max("c"), 6).alias("score"), F.min_by("pos", F.struct(-F.col("c"), "pos")).cast("long").alias("winner"))
