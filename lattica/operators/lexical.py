"""BM25 and hybrid scoring over token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.graph import settled
from lattica.operators.sizes import small

# BM25 parameters, floor share of the Okapi form, boost and cut-offs of the hybrid rules.
K1, B, OKAPI_EPSILON = 1.5, 0.75, 0.25
BOOST, NEAR_PERCENTILE, LEXICAL_PERCENTILE = 1.5, 0.20, 0.80


class LexicalIndex:
    """Document lengths and frequencies of docs (id, tokens array). All statistics cover all documents.

    Tokens meet the queries' terms before anything is counted, so only postings of asked terms are shuffled.
    """

    def __init__(self, docs: DataFrame, floor_negative: bool = False):
        self.docs = docs
        length = F.greatest(F.size("tokens"), F.lit(0))
        self.totals = docs.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg(length).alias("mean_length"))
        self.postings = docs.select("id", length.alias("length"), F.explode("tokens").alias("term"))
        self.floor_negative = floor_negative

    def _idf_of(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.totals)).select("term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # totals is one row

    def idf(self, tf: DataFrame | None = None) -> DataFrame:
        """term, idf = ln(N - n + .5) - ln(n + .5) of the terms in tf (else all), which may be negative; the Okapi form raises negatives to a share of the mean over all terms."""
        every = self.postings.select("id", "term").distinct()
        raw = self._idf_of((every if tf is None else tf).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        if not self.floor_negative:
            return raw
        mean = self._idf_of(every.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).agg(F.avg("idf").alias("mean"))
        return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, OKAPI_EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))

    def _matches(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Counts (query, term, qf) of the queries, and postings (id, term, length, tf) of their terms; a frequent term's postings are split by adaptive execution."""
        q = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qf"))
        asked = self.postings.join(small(q.select("term").distinct(), 40), "term", "left_semi")
        return q, asked.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """query, id, score of documents that share a term; a query term counts as often as it occurs."""
        q, tf = self._matches(queries)
        tf = settled(tf)  # counted once, for frequencies and scores
        rows = tf.join(small(q.join(self.idf(tf), "term"), 60), "term").crossJoin(F.broadcast(self.totals))
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        return rows.groupBy("query", "id").agg(F.sum(F.col("qf") * part).alias("score"))

    def saturation_scores(self, queries: DataFrame) -> DataFrame:
        """query, id, score: tf / (tf + 1) over distinct query terms, by the root of the length."""
        q, tf = self._matches(queries)
        rows = tf.join(small(q, 50), "term")
        return rows.groupBy("query", "id").agg((F.sum(F.col("tf") / (F.col("tf") + 1.0)) / F.sqrt(F.first("length"))).alias("score"))


def max_normalised(scores: DataFrame, key: str = "query", score: str = "score") -> DataFrame:
    """Scores by the greatest of their query where that is positive."""
    top = F.max(score).over(W.partitionBy(key))
    return scores.withColumn(score, F.when(top > 0, F.col(score) / F.when(top > 0, top)).otherwise(F.col(score)))


def top(scores: DataFrame, k: int, key: str = "query", score: str = "score") -> DataFrame:
    """The k best of each query with their rank; scores are compared at 9 digits, then by id."""
    w = W.partitionBy(key).orderBy(F.desc(F.round(score, 9)), "id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def blended(near: DataFrame, lexical: DataFrame, near_weight: float, boost: float = 1.0) -> DataFrame:
    """query, id, score over the union of both sides (query, id, score), missing ones 0, boosted where both are there."""
    n, x = near.select("query", "id", F.col("score").alias("near")), lexical.select("query", "id", F.col("score").alias("lexical"))
    both = n.join(x, ["query", "id"], "full")
    factor = F.when(F.col("near").isNotNull() & F.col("lexical").isNotNull(), boost).otherwise(1.0)
    return both.select("query", "id", (factor * (near_weight * F.coalesce("near", F.lit(0.0)) + (1 - near_weight) * F.coalesce("lexical", F.lit(0.0)))).alias("score"))


def blended_left(candidates: DataFrame, near: DataFrame, lexical: DataFrame, near_weight: float, needs_near: bool = False) -> DataFrame:
    """query, id, score of given candidates; with needs_near a candidate without a vector scores 0."""
    rows = candidates.join(near.select("query", "id", F.col("score").alias("near")), ["query", "id"], "left").join(lexical.select("query", "id", F.col("score").alias("lexical")), ["query", "id"], "left")
    score = near_weight * F.coalesce("near", F.lit(0.0)) + (1 - near_weight) * F.coalesce("lexical", F.lit(0.0))
    return rows.select("query", "id", (F.when(F.col("near").isNull(), 0.0).otherwise(score) if needs_near else score).alias("score"))


def common_or_fallback(near: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """query, id: what both sides keep after their percentile cuts; else what both found; else the first k/2 of each.

    near has query, id, distance, rank; lexical has query, id, score, rank. All three sets are tagged by priority and each query
    keeps its best non-empty one.
    """
    n = near.withColumn("_cut", F.percentile("distance", F.lit(NEAR_PERCENTILE)).over(W.partitionBy("query")))
    x = lexical.withColumn("_cut", F.percentile(F.when(F.col("score") > 0, F.col("score")), F.lit(LEXICAL_PERCENTILE)).over(W.partitionBy("query")))
    both = n.select("query", "id", (F.col("distance") <= F.col("_cut") + 1e-12).alias("near_kept")).join(x.select("query", "id", F.coalesce(F.col("score") >= F.col("_cut") - 1e-12, F.lit(False)).alias("lexical_kept")), ["query", "id"])
    tagged = both.select("query", "id", F.when(F.col("near_kept") & F.col("lexical_kept"), 1).otherwise(2).alias("priority"))
    heads = near.where(F.col("rank") <= k // 2).select("query", "id").unionByName(lexical.where(F.col("rank") <= k // 2).select("query", "id")).distinct().withColumn("priority", F.lit(3))
    sets = tagged.unionByName(tagged.where("priority = 1").withColumn("priority", F.lit(2))).unionByName(heads).distinct()
    best = F.min("priority").over(W.partitionBy("query"))
    return sets.withColumn("_best", best).where("priority = _best").select("query", "id").distinct()


def entity_bonus(exact: Column, partial: Column) -> Column:
    return 0.1 * exact + 0.05 * partial
