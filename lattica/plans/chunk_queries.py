"""Chunking, keywords, summaries, tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import text as tx
from lattica.operators import chunking as ch
from lattica.sources.tables import table

WS = r"[ \t\n\x0B\f\r]"
LIST = "['" + "','".join(tx.KEYWORD_STOPWORDS) + "']"
SENTENCES = rf"""
s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text,''), '([.?!]){WS}+', '\1'||chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^{WS}+', ''), '{WS}+$', '')), lambda x: x <> '') AS ss FROM documents),
sent AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s0)"""
CONTEXT = SENTENCES + """,
ctx AS (SELECT doc_id, pos, sentence, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS context FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
DISTANCES = CONTEXT + r""",
tok AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(context), '[\p{L}\p{N}_]+')) AS t FROM ctx),
cnt AS (SELECT doc_id, pos, ('0x'||substr(md5(t),1,4))::INT % 64 AS b, count(*)::DOUBLE AS n FROM tok GROUP BY ALL),
nrm AS (SELECT doc_id, pos, sqrt(sum(n*n)) AS z FROM cnt GROUP BY ALL),
vec AS (SELECT doc_id, pos, b, n/z AS x FROM cnt JOIN nrm USING (doc_id, pos)),
cs AS (SELECT a.doc_id, a.pos, sum(a.x*b.x) AS c FROM vec a JOIN vec b ON a.doc_id=b.doc_id AND b.pos=a.pos+1 AND a.b=b.b GROUP BY ALL),
dist AS (SELECT s.doc_id, s.pos, round(1-coalesce(c,0), 9) AS distance FROM sent s JOIN (SELECT doc_id, max(pos) AS last FROM sent GROUP BY 1) l ON s.doc_id=l.doc_id AND s.pos < l.last LEFT JOIN cs ON cs.doc_id=s.doc_id AND cs.pos=s.pos)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _sentences(spark, sf_dir):
    return ch.sentence_rows(_docs(spark, sf_dir))


def _distances(spark, sf_dir):
    return ch.adjacent_distances(ch.context_windows(_sentences(spark, sf_dir)))


@query(f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sent")
def c1_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query(f"""WITH RECURSIVE {SENTENCES},
step(doc_id, i) AS (SELECT doc_id, 1 FROM s0 WHERE len(ss) > 0 UNION ALL SELECT t.doc_id, t.i + CASE WHEN length(ss[t.i]) < 25 THEN 2 ELSE 1 END FROM step t JOIN s0 USING (doc_id) WHERE t.i + CASE WHEN length(ss[t.i]) < 25 THEN 2 ELSE 1 END <= len(ss)),
unit AS (SELECT doc_id, i, CASE WHEN length(ss[i]) < 25 AND i < len(ss) THEN ss[i]||' '||ss[i+1] ELSE ss[i] END AS u, length(ss[i]) < 25 AND i = len(ss) AS tail_piece FROM step JOIN s0 USING (doc_id)),
grp AS (SELECT doc_id, i, u, row_number() OVER w - CASE WHEN tail_piece AND row_number() OVER w > 1 THEN 2 ELSE 1 END AS pos FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, pos, string_agg(u, ' ' ORDER BY i) AS sentence FROM grp GROUP BY ALL""")
def c2_merged_short_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.merged_short_sentences(tx.sentences("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CONTEXT} SELECT doc_id, pos, context FROM ctx")
def c3_context_windows(spark, sf_dir):
    return ch.context_windows(_sentences(spark, sf_dir)).select("doc_id", "pos", "context")


@query(f"WITH {DISTANCES} SELECT doc_id, pos, round(distance, 6) + 0.0 AS distance FROM dist")
def c4_adjacent_distances(spark, sf_dir):
    return _distances(spark, sf_dir).select("doc_id", "pos", (F.round(F.round("distance", 9), 6) + F.lit(0.0)).alias("distance"))


@query(f"""WITH {DISTANCES},
cut AS (SELECT doc_id, quantile_cont(distance, 0.8) AS thr FROM dist GROUP BY 1),
brk AS (SELECT doc_id, pos+1 AS pos, (distance > thr + 1e-9)::INT AS opens FROM dist JOIN cut USING (doc_id)),
marked AS (SELECT sent.doc_id, sent.pos, sentence, sum(coalesce(opens,0)) OVER (PARTITION BY sent.doc_id ORDER BY sent.pos) AS chunk FROM sent LEFT JOIN brk ON brk.doc_id=sent.doc_id AND brk.pos=sent.pos)
SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS content FROM marked GROUP BY doc_id, chunk""")
def c5_semantic_chunks(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    return ch.semantic_chunks(s, _distances(spark, sf_dir))


def _fixed_chunks(sentences, size):
    return sentences.select("doc_id", "pos", F.floor(F.col("pos") / size).alias("chunk"))


@query()
def c6_merge_small_chunks(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    return ch.rechunked(s, _fixed_chunks(s, 2), ch.merged_to_fixpoint)


@query()
def c7_resize_chunks(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    return ch.rechunked(s, _fixed_chunks(s, 24), ch.resized)


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
PART_BLOCKS = """b0 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
b AS (SELECT * EXCLUDE (n), CASE WHEN rn // 10 = (n-1)//10 AND (n-1)//10 > 0 AND n % 10 BETWEEN 1 AND 4 THEN rn//10 - 1 ELSE rn//10 END AS block FROM b0)"""


def _part_blocks(spark, sf_dir):
    return ch.row_blocks(table(spark, sf_dir, "part"), ["p_partkey"], "p_brand")


@query(f"WITH {PART_BLOCKS} SELECT p_brand, block, count(*) AS n_rows, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM b GROUP BY ALL")
def c8_table_blocks(spark, sf_dir):
    return _part_blocks(spark, sf_dir).groupBy("p_brand", "block").agg(F.count(F.lit(1)).alias("n_rows"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


_CELLS = "[" + ",".join(f"coalesce({c}::VARCHAR,'')" for c in PART_COLUMNS) + "]"
_NAMED = "concat_ws(' | '," + ",".join(f"'{c}: '||{c}::VARCHAR" for c in PART_COLUMNS) + ")"


def _block_sql(name, head, line):
    return f"WITH {PART_BLOCKS} SELECT p_brand, block, count(*) AS n_rows, {head}||string_agg({line}, chr(10) ORDER BY rn) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, block ORDER BY rn) AS i FROM b) GROUP BY p_brand, block"


_PLAIN_HEAD = f"'{' '.join(PART_COLUMNS)}'||chr(10)||'{' '.join(' ' for _ in PART_COLUMNS)}'||chr(10)"
_MARK_HEAD = f"'| {' | '.join(PART_COLUMNS)} |'||chr(10)||'| {' | '.join('---' for _ in PART_COLUMNS)} |'||chr(10)"


@query(_block_sql("plain", _PLAIN_HEAD, f"array_to_string({_CELLS}, ' ')"))
def c9_rows_as_text(spark, sf_dir):
    return ch.block_texts(_part_blocks(spark, sf_dir), PART_COLUMNS, ["p_brand", "block"]).select("p_brand", "block", "n_rows", "plain")


@query(_block_sql("labelled", f"'Table columns: {', '.join(PART_COLUMNS)}'||chr(10)", f"'Row '||i||': '||{_NAMED}"))
def c10_rows_as_labelled_text(spark, sf_dir):
    return ch.block_texts(_part_blocks(spark, sf_dir), PART_COLUMNS, ["p_brand", "block"]).select("p_brand", "block", "n_rows", "labelled")


@query(_block_sql("markdown", _MARK_HEAD, f"'| '||array_to_string(list_transform({_CELLS}, lambda v: replace(v,'|','\\|')), ' | ')||' |'"))
def c11_rows_as_markdown(spark, sf_dir):
    return ch.block_texts(_part_blocks(spark, sf_dir), PART_COLUMNS, ["p_brand", "block"]).select("p_brand", "block", "n_rows", "markdown")


@query("""SELECT 'p_size' AS "column", 'numeric '||min(p_size)||' to '||max(p_size) AS description FROM part
UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) < 10 THEN 'categories: '||(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part)) ELSE 'text in '||count(p_name)||' of '||count(*) END FROM part
UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) < 10 THEN 'categories: '||(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_brand AS v FROM part)) ELSE 'text in '||count(p_brand)||' of '||count(*) END FROM part
UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) < 10 THEN 'categories: '||(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part)) ELSE 'text in '||count(p_type)||' of '||count(*) END FROM part""")
def c12_column_profile(spark, sf_dir):
    return ch.profile(table(spark, sf_dir, "part"), {"p_size": True, "p_name": False, "p_brand": False, "p_type": False})


KEYWORDS = rf"""kt0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text,'')), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) > 2 AND NOT list_contains({LIST}, w)) AS ws FROM documents),
kt AS (SELECT doc_id, unnest(ws) AS keyword, generate_subscripts(ws,1) AS pos FROM kt0),
kc AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS p FROM kt GROUP BY ALL),
kw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank, keyword, n FROM kc QUALIFY rank <= 10)"""


@query(f"WITH {KEYWORDS} SELECT doc_id, rank, keyword, n FROM kw")
def c13_keywords(spark, sf_dir):
    return ch.keywords(_docs(spark, sf_dir))


@query(f"""WITH {PART_BLOCKS}, t0 AS (SELECT p_brand, block, string_agg(concat_ws(' ', p_name, p_type, p_size::VARCHAR), ' ' ORDER BY rn) AS t FROM b GROUP BY ALL),
t1 AS (SELECT p_brand, block, list_filter(string_split(lower(t), ' '), lambda w: len(w) > 2 AND NOT list_contains({LIST}, w)) AS ws FROM t0),
t2 AS (SELECT p_brand, block, unnest(ws) AS keyword, generate_subscripts(ws,1) AS pos FROM t1),
c AS (SELECT p_brand, block, keyword, count(*) AS n, min(pos) AS p FROM t2 GROUP BY ALL)
SELECT p_brand, block, row_number() OVER (PARTITION BY p_brand, block ORDER BY n DESC, p) AS rank, keyword, n FROM c QUALIFY rank <= 10""")
def c14_table_keywords(spark, sf_dir):
    rows = _part_blocks(spark, sf_dir).select("p_brand", "block", "rn", F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("line"))
    texts = rows.groupBy("p_brand", "block").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("r"))
    stop = F.array(*[F.lit(x) for x in tx.KEYWORD_STOPWORDS])
    words = F.filter(F.split(F.lower(F.array_join(F.transform("r", lambda x: x["line"]), " ")), " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    toks = texts.select("p_brand", "block", F.posexplode(words).alias("pos", "keyword"))
    counts = toks.groupBy("p_brand", "block", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = ch.W.partitionBy("p_brand", "block").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("p_brand", "block", "rank", "keyword", "n")


@query("SELECT doc_id, CASE WHEN length(coalesce(text,'')) > 200 THEN substr(text,1,200)||'...' ELSE coalesce(text,'') END AS summary FROM documents")
def c15_summaries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.summary("text").alias("summary"))


@query(f"WITH {PART_BLOCKS} SELECT p_brand, block, 'Table chunk '||block||' with '||count(*)||' rows containing columns: p_partkey, p_name, p_brand and 2 more' AS summary FROM b GROUP BY p_brand, block")
def c16_table_summaries(spark, sf_dir):
    n = _part_blocks(spark, sf_dir).groupBy("p_brand", "block").agg(F.count(F.lit(1)).alias("n"))
    return n.select("p_brand", "block", ch.table_summary(F.col("block"), F.col("n"), PART_COLUMNS).alias("summary"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text,'') AS t, array_to_string(list_filter(regexp_extract_all(coalesce(text,''), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains({LIST}, lower(w))), ' ') AS k FROM documents)
SELECT doc_id, CASE WHEN k = '' THEN t ELSE k END AS content FROM t""")
def c17_without_stopwords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.without_stopwords("text").alias("content"))


@query(f"""WITH {SENTENCES} SELECT doc_id, pos, replace(d.source, '/', '_')||'_chunk_'||pos||'_'||substr(sha256(sentence),1,12) AS chunk_id,
substr(md5(d.source),1,8)||'_'||substr(sha256(sentence),1,16) AS cache_key FROM sent JOIN documents d USING (doc_id)""")
def c18_chunk_ids(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", "source", F.posexplode(tx.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))
    cleaned = F.regexp_replace("source", r"[^\w\-_]", "_")
    return rows.select(
        "doc_id", "pos", F.concat(cleaned, F.lit("_chunk_"), F.col("pos").cast("string"), F.lit("_"), tx.content_digest("sentence")).alias("chunk_id"),
        F.concat(F.substring(F.md5(F.col("source").cast("binary")), 1, 8), F.lit("_"), tx.content_digest("sentence", 16)).alias("cache_key"),
    )


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND sha256(coalesce(o.text,'')) = sha256(coalesce(d.text,'')))""")
def c19_unprocessed_documents(spark, sf_dir):
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = _docs(spark, sf_dir).select("doc_id", digest.alias("digest"))
    done = docs.where("doc_id % 3 = 0").select("digest")
    return docs.where("doc_id % 3 <> 0").join(done, "digest", "left_anti").select("doc_id")


@query(f"""WITH {DISTANCES} SELECT doc_id, count(*) AS n, round(avg(distance),6) AS mean, round(stddev_pop(distance),6) AS std, min(distance) AS least, max(distance) AS most, round(median(distance),6) AS med,
count(*) FILTER (distance < .2) AS b0, count(*) FILTER (distance >= .2 AND distance < .4) AS b1, count(*) FILTER (distance >= .4 AND distance < .6) AS b2, count(*) FILTER (distance >= .6 AND distance < .8) AS b3, count(*) FILTER (distance >= .8) AS b4,
round(count(*) FILTER (distance > .5) / count(*)::DOUBLE, 6) AS above FROM dist GROUP BY 1""")
def c20_distance_distribution(spark, sf_dir):
    d = F.col("distance")
    bins = [F.count_if((d >= lo) & (d < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate([(-9.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 9.0)])]
    rows = _distances(spark, sf_dir).withColumn("distance", F.round("distance", 9))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d), 6).alias("std"), F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.expr("percentile(distance, 0.5)"), 6).alias("med"),
        *bins, F.round(F.count_if(d > 0.5) / F.count(F.lit(1)), 6).alias("above"),
    )


_COLOURS = "['" + "','".join(tx.COLOURS) + "']"


@query(f"SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_brand IS NOT NULL AND lower(p_brand) <> 'unknown' THEN [p_brand] ELSE [] END, list_filter({_COLOURS}, lambda c: contains(lower(concat_ws(' ', p_name, p_type)), c))), ',') AS entities FROM part")
def c21_entities(spark, sf_dir):
    brand = F.when(F.col("p_brand").isNotNull() & (F.lower("p_brand") != "unknown"), F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.concat(brand, tx.colours_in(F.concat_ws(" ", "p_name", "p_type"))), ",").alias("entities"))


@query("""WITH n AS (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1)
SELECT n_nationkey, n_name AS plain, n_name||' (level '||n_regionkey||')' AS with_level, n_name||' ('||coalesce(c,0)||' customers)' AS with_counts, n_name||' (level '||n_regionkey||', '||coalesce(c,0)||' customers)' AS combined FROM nation LEFT JOIN n ON c_nationkey = n_nationkey""")
def c22_context_labels(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    rows = table(spark, sf_dir, "nation").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    count, level = F.coalesce("count", F.lit(0)).cast("string"), F.col("n_regionkey").cast("string")
    name = F.col("n_name")
    return rows.select(
        "n_nationkey", name.alias("plain"), F.concat(name, F.lit(" (level "), level, F.lit(")")).alias("with_level"),
        F.concat(name, F.lit(" ("), count, F.lit(" customers)")).alias("with_counts"), F.concat(name, F.lit(" (level "), level, F.lit(", "), count, F.lit(" customers)")).alias("combined"),
    )
