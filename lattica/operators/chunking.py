"""Documents and tables into chunks: sentence windows, semantic breakpoints, row blocks, profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.functions import vectors as vx

# Fixed values of the chunking rules.
BREAK_PERCENTILE, MIN_SENTENCES, MERGE_BELOW, SPLIT_ABOVE, PASSES = 80, 3, 6, 20, 2
BLOCK_ROWS, LEAST_ROWS, KEYWORDS = 10, 5, 10


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(tx.sentences(text)).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def context_windows(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """sentence_rows with context: the sentence between its neighbours."""
    w = W.partitionBy(key).orderBy("pos")
    return sentences.withColumn("context", F.concat_ws(" ", F.lag("sentence").over(w), "sentence", F.lead("sentence").over(w)))


def adjacent_distances(sentences: DataFrame, key: str = "doc_id", text: str = "context", dimension: int = 64) -> DataFrame:
    """key, pos, distance: 1 - cosine of the hashed embeddings of a sentence and the next one; 1 if one has no word.

    A sentence's counts are one dense array of `dimension` numbers, made from its words in place; adjacent rows meet in one window.
    """
    rows = sentences.select(key, "pos", vx.hashed_vector(tx.words(text), dimension).alias("v"))
    nxt = F.lead("v").over(W.partitionBy(key).orderBy("pos"))
    cos = F.try_divide(vx.dot("v", "w"), vx.norm("v") * vx.norm("w"))
    return rows.withColumn("w", nxt).where("w IS NOT NULL").select(key, "pos", (1 - F.coalesce(cos, F.lit(0.0))).alias("distance"))


def semantic_chunks(sentences: DataFrame, distances: DataFrame, key: str = "doc_id", percentile: int = BREAK_PERCENTILE) -> DataFrame:
    """key, chunk, n_sentences, content: a break after each distance above the document's own percentile. Distances are rounded to 9 digits, so equal ones never break."""
    d = distances.withColumn("distance", F.round("distance", 9))
    cut = d.groupBy(key).agg(F.expr(f"percentile(distance, {percentile / 100})").alias("threshold"))
    breaks = d.join(cut, key).select(key, (F.col("pos") + 1).alias("pos"), (F.col("distance") > F.col("threshold") + 1e-9).cast("int").alias("opens"))
    marked = sentences.join(breaks, [key, "pos"], "left").withColumn("chunk", F.sum(F.coalesce("opens", F.lit(0))).over(W.partitionBy(key).orderBy("pos")))
    parts = marked.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n_sentences"), F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("p"))
    return parts.select(key, "chunk", "n_sentences", F.array_join(F.transform("p", lambda s: s["sentence"]), " ").alias("content"))


def embedded(text: str, dimension: int = 64) -> np.ndarray:
    """The hashed embedding of one text, as vectors.hashed_embedding gives it."""
    import hashlib
    import re

    v = np.zeros(dimension)
    for t in re.findall(r"[^\W]+", text.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dimension] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def merged_to_fixpoint(chunks: list[list[str]], least: int = MIN_SENTENCES, embed=embedded) -> list[list[str]]:
    """The first chunk with fewer than `least` sentences joins the more similar neighbour (the one before on ties) until none is left."""
    chunks = [list(c) for c in chunks]
    vecs = [embed(" ".join(c)) for c in chunks]
    at = 0
    while len(chunks) > 1:
        at = next((i for i in range(at, len(chunks)) if len(chunks[i]) < least), -1)
        if at < 0:
            break
        sides = [(-float(vecs[at] @ vecs[j]), j) for j in (at - 1, at + 1) if 0 <= j < len(chunks)]
        first = min(at, min(sides)[1])
        chunks[first : first + 2] = [chunks[first] + chunks[first + 1]]
        vecs[first : first + 2] = [embed(" ".join(chunks[first]))]
        at = max(0, first)  # chunks before it are long enough
    return chunks


def resized(chunks: list[list[str]], below: int = MERGE_BELOW, above: int = SPLIT_ABOVE, passes: int = PASSES, embed=embedded) -> list[list[str]]:
    """At most `passes` times: a chunk under `below` sentences joins the more similar of the last emitted and the next chunk; one over `above` is halved."""
    for _ in range(passes):
        out: list[list[str]] = []
        changed, i = False, 0
        while i < len(chunks):
            c = chunks[i]
            if len(c) < below and len(chunks) > 1 and (out or i + 1 < len(chunks)):
                v = embed(" ".join(c))
                sides = [(-float(v @ embed(" ".join(out[-1]))), 0)] if out else []
                if i + 1 < len(chunks):
                    sides.append((-float(v @ embed(" ".join(chunks[i + 1]))), 1))
                if min(sides)[1] == 0:
                    out[-1] = out[-1] + c
                else:
                    out.append(c + chunks[i + 1])
                    i += 1
                changed = True
            elif len(c) > above:
                out += [c[: len(c) // 2], c[len(c) // 2 :]]
                changed = True
            else:
                out.append(c)
            i += 1
        chunks = out
        if not changed:
            break
    return chunks


def rechunked(sentences: DataFrame, chunks_of: DataFrame, rule, key: str = "doc_id") -> DataFrame:
    """key, chunk, n_sentences, content after a sequential rule on each document's chunks (sentences must carry chunk via chunks_of: key, pos, chunk)."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        parts = [g["sentence"].tolist() for _, g in pdf.groupby("chunk", sort=True)]
        done = rule(parts)
        return pd.DataFrame({key: pdf[key].iloc[0], "chunk": range(len(done)), "n_sentences": [len(c) for c in done], "content": [" ".join(c) for c in done]})

    rows = sentences.join(chunks_of, [key, "pos"]).select(key, "pos", "sentence", "chunk")
    return rows.groupBy(key).applyInPandas(apply, f"{key} long, chunk long, n_sentences long, content string")


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = KEYWORDS) -> DataFrame:
    """key, rank, keyword, n: the most frequent content words, ties in order of first occurrence."""
    toks = docs.select(key, F.posexplode(tx.content_words(text)).alias("pos", "keyword"))
    counts = toks.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = W.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select(key, "rank", "keyword", "n")


def row_blocks(rows: DataFrame, order: list[str], table: str | None = None, size: int = BLOCK_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """rows with rn (from 0) and block: `size` rows each; a last block under `least` rows joins the one before. table names the column that tells tables apart."""
    part = W.partitionBy(table) if table else W.partitionBy(F.lit(0))
    numbered = rows.withColumns({"rn": F.row_number().over(part.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(part)})
    block = F.floor(F.col("rn") / size)
    tail = F.col("_n") % size
    last = F.floor((F.col("_n") - 1) / size)
    return numbered.withColumn("block", F.when((block == last) & (last > 0) & (tail > 0) & (tail < least), block - 1).otherwise(block)).drop("_n")


def _cell(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def block_texts(blocks: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Each block as text: plain (header, blank line, one line per row), labelled (nulls left out) and markdown."""
    cells = F.array(*[_cell(c) for c in columns])
    named = F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    piped = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda v: F.replace(v, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rows = blocks.select(*keys, "rn", F.array_join(cells, " ").alias("plain"), named.alias("named"), piped.alias("piped"))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "plain", "named", "piped"))).alias("r"), F.count(F.lit(1)).alias("n_rows"))
    head, blank = " ".join(columns), " ".join(" " for _ in columns)
    return got.select(
        *keys, "n_rows",
        F.concat_ws("\n", F.lit(head), F.lit(blank), F.array_join(F.transform("r", lambda x: x["plain"]), "\n")).alias("plain"),
        F.concat_ws("\n", F.lit("Table columns: " + ", ".join(columns)), F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), x["named"])), "\n")).alias("labelled"),
        F.concat_ws("\n", F.lit("| " + " | ".join(columns) + " |"), F.lit("| " + " | ".join("---" for _ in columns) + " |"), F.array_join(F.transform("r", lambda x: x["piped"]), "\n")).alias("markdown"),
    )


def profile(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """column, description of each column (value: whether numeric): empty, numeric range, categories (under ten values), or how many rows have text.

    Counts come first; only sets known to have under ten values are gathered.
    """
    texts = [c for c, numeric in columns.items() if not numeric]
    few = df.agg(*[F.countDistinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, numeric in columns.items():
        aggs += [F.count(c).alias(f"{c}__n"), (F.min(c) if numeric else F.lit(None)).cast("string").alias(f"{c}__lo"), (F.max(c) if numeric else F.lit(None)).cast("string").alias(f"{c}__hi")]
        aggs.append((F.array_join(F.array_sort(F.collect_set(c)), ", ") if 0 < few.get(c, 0) < 10 else F.lit(None).cast("string")).alias(f"{c}__v"))
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(numeric).alias("numeric"), F.col("n"), F.col(f"{c}__n").alias("filled"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"), F.col(f"{c}__v").alias("set")) for c, numeric in columns.items()])))
    text = (
        F.when(F.col("filled") == 0, F.lit("empty"))
        .when(F.col("numeric"), F.concat(F.lit("numeric "), "lo", F.lit(" to "), "hi"))
        .when(F.col("set").isNotNull(), F.concat(F.lit("categories: "), "set"))
        .otherwise(F.concat(F.lit("text in "), F.col("filled").cast("string"), F.lit(" of "), F.col("n").cast("string")))
    )
    return rows.select("column", text.alias("description"))


def table_summary(name: Column, n: Column, columns: list[str]) -> Column:
    more = f" and {len(columns) - 3} more" if len(columns) > 3 else ""
    return F.concat(F.lit("Table chunk "), name.cast("string"), F.lit(" with "), n.cast("string"), F.lit(" rows containing columns: " + ", ".join(columns[:3]) + more))
