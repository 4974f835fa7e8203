"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of all items, each text scanned once.

A worker builds the automaton once. Beyond PATTERN_CHARS of patterns (about 200,000 characters of items), the items are dealt into
several automata, each with a scan of its own, so that neither the driver nor a worker ever holds more; no window is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import located, scratch

#: Word characters after A-Z are lower-cased, and the words of a window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Parameter: characters of patterns in one automaton (about 60 bytes of memory each).
PATTERN_CHARS = 2_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ORIGINAL = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    w = [x.decode("utf-8", "surrogatepass") for x in words(text)]
    return [] if not w else [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]


def pattern_sets(items: list[tuple[object, str | None]], size: int = WINDOW, chars: int = PATTERN_CHARS) -> list[dict[str, list[str]]]:
    """Dicts of window -> ids of the items that have it, as many as the bound asks for."""
    sets: list[dict[str, list[str]]] = [{}]
    used = 0
    of: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            of.setdefault(w, set()).add(str(item))
    for w, ids in of.items():
        if used + len(w) > chars and sets[-1]:
            sets.append({})
            used = 0
        sets[-1][w] = sorted(ids)
        used += len(w)
    return sets


def automaton(patterns: dict[str, list[str]]):
    a = ahocorasick.Automaton()
    for w, ids in patterns.items():
        a.add_word(f" {w} ", (len(w), w.count(" ") + 1, ids))
    a.make_automaton()
    return a


def scan(text: str | None, a) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words; merged hit runs [first, end) in words; ids of items with occurring windows."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], []
    joined = (b" " + b" ".join(w) + b" ").decode("utf-8", "surrogatepass")
    ids: set[str] = set()
    runs: list[list[int]] = []
    starts = None
    for end, (chars, n, items) in a.iter(joined):
        if starts is None:  # character at which each word starts, once a text has a hit
            starts = np.cumsum([1, *(len(x.decode("utf-8", "surrogatepass")) + 1 for x in w)])
        ids.update(items)
        first = int(np.searchsorted(starts, end - chars))
        runs.append([first, first + n])
    runs.sort()
    merged: list[tuple[int, int]] = []
    for s, e in runs:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return len(w), merged, sorted(ids)


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit runs as code point offsets [start, end) in the text as it was."""
    at = [m.span() for m in _ORIGINAL.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


RUNS, SPANS = "array<struct<first long, until long>>", "array<struct<start long, until long>>"


def _span_rows(text: str | None, runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": s, "until": e} for s, e in original_spans(text, runs)] if runs else []


#: Of this worker: the automaton that it built last, under the name of its pattern set.
_BUILT: dict[str, object] = {}


def _automaton(name: str, patterns):
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(patterns.value)
    return _BUILT[name]


def _scanner(bound):
    name = uuid.uuid4().hex

    @F.pandas_udf(f"n_words long, runs {RUNS}, spans {SPANS}, items array<string>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = _automaton(name, bound)
        for texts in batches:
            out = []
            for t in texts:
                n, runs, items = scan(t, a)
                out.append((n, [{"first": s, "until": e} for s, e in runs], _span_rows(t, runs), items))
            yield pd.DataFrame(out, columns=["n_words", "runs", "spans", "items"])

    return scanned


def _item_groups(benchmark: DataFrame, size: int, chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in groups of about `chars` pattern characters at most, of which the driver holds one at a time. A window repeats a word at most size times."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * size // chars))
    for g in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        yield [(r.item_id, r.text) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chars: int = PATTERN_CHARS) -> DataFrame:
    """docs with a column hit: n_words, runs of hit words, their spans in the original text, sorted ids of the items found.

    Null and empty texts have no words; an item without words has no window, and neither has an empty benchmark. Texts are scanned
    whole at any length, one at a time. Windows that several items share count for each of them; repeated items and rows change
    nothing. An empty table gives an empty table. A column named hit is replaced, others stay.
    """
    spark = docs.sparkSession
    given = [c for c in docs.columns if c != "hit"]
    first, rows, folder = None, None, None
    n_sets = 0
    for items in _item_groups(benchmark, size, chars):
        for patterns in pattern_sets(items, size, chars):
            if first is None:  # the only set of all but very large benchmarks
                first = patterns
                continue
            if folder is None:
                rows, folder = located(docs), scratch(spark, "hits")
                _pass(rows, spark.sparkContext.broadcast(first), f"{folder}/s0")
            n_sets += 1
            _pass(rows, spark.sparkContext.broadcast(patterns), f"{folder}/s{n_sets}")
    if folder is None:
        shared = spark.sparkContext.broadcast(first or {})
        return docs.select(*[docs[f"`{c}`"] for c in given], _scanner(shared)(docs["text"]).alias("hit"))
    found = spark.read.schema(f"file string, at long, runs {RUNS}, items array<string>").parquet(f"{folder}/*")
    union = found.groupBy("file", "at").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = union.select("file", "at", _merged("runs").alias("runs"), "items")  # at most one row for each set and text

    @F.pandas_udf(f"n_words long, spans {SPANS}")
    def spans(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(words(t)), _span_rows(t, [(x["first"], x["until"]) for x in r])) for t, r in zip(texts, runs, strict=True)], columns=["n_words", "spans"])

    none = F.expr(f"cast(array() as {RUNS.replace('long', 'bigint')})")
    out = rows.join(union, ["file", "at"], "left").select("row", F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    out = out.withColumn("w", spans("row.text", "runs"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in given], F.struct("w.n_words", "runs", "w.spans", "items").alias("hit"))


def _pass(rows: DataFrame, patterns, out: str) -> None:
    """One scan of all texts for one pattern set; only texts with a hit are written."""
    found = rows.select("file", "at", _scanner(patterns)("row.text").alias("h"))
    found.where(F.size("h.items") > 0).select("file", "at", "h.runs", "h.items").write.parquet(out)
    patterns.unpersist()


def _merged(runs: str):
    """Sorted runs with those that touch made one."""
    last = "element_at(acc, -1)"
    return F.expr(
        f"aggregate(array_sort({runs}), cast(array() as {RUNS.replace('long', 'bigint')}), (acc, r) -> if(size(acc) > 0 and r.first <= {last}.until, "
        f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', {last}.first, 'until', greatest({last}.until, r.until)))), concat(acc, array(r))))"
    )


def n_hit(hit: str = "hit"):
    return F.expr(f"aggregate({hit}.runs, 0L, (n, r) -> n + r.until - r.first)")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of an item; columns as given."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return find(rows, benchmark).where(F.size("hit.runs") == 0).select("row.*")
