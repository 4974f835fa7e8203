"""Text expressions: sentences, tokens, keywords, summaries, names, list literals. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and lengths of the keyword, lexical scoring and colour rules.
KEYWORD_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would should could can may might must shall this that these those"
).split()
SCORE_STOPWORDS = "the a an and or but in on at to for of with by from as is was are were be been being".split()
COLOURS = (
    "red blue green yellow orange purple pink brown black white gray grey navy turquoise teal maroon silver gold beige tan khaki olive burgundy coral salmon magenta cyan lime indigo violet"
).split()
SHORT_SENTENCE, SUMMARY_CHARS, MIN_TOKEN = 25, 200, 3

WORD = r"[\p{L}\p{N}_]+"
WHITE = r"[ \t\n\x0B\f\r]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def sentences(text: Column | str) -> Column:
    """Pieces after '.', '?' or '!' and white space, trimmed, without empty ones."""
    parts = F.split(_text(text), r"(?<=[.?!])[ \t\n\x0B\f\r]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda s: s != "")


def merged_short_sentences(found: Column, short: int = SHORT_SENTENCE) -> Column:
    """A sentence under `short` characters takes the next one in; a short one at the end joins the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, s):
        joined = F.concat_ws(" ", acc["open"], s)
        closes = acc["open"].isNotNull() | (F.length(s) >= short)
        return F.struct(F.when(closes, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(closes, F.lit(None).cast("string")).otherwise(s).alias("open"))

    def finish(acc):
        n = F.size(acc["done"])
        tail = F.when(n == 0, F.array(acc["open"])).otherwise(F.concat(F.slice(acc["done"], 1, n - 1), F.array(F.concat_ws(" ", F.element_at(acc["done"], -1), acc["open"]))))
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(tail)

    return F.aggregate(found, empty, step, finish)


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores; nothing dropped."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(f"({WORD})"), F.lit(1))


def _listed(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def content_words(text: Column | str, stopwords: list[str] = KEYWORD_STOPWORDS) -> Column:
    """Words that are no stopwords and have more than two characters."""
    stop = _listed(stopwords)
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) >= MIN_TOKEN))


def lexical_words(text: Column | str, stopwords: list[str] = KEYWORD_STOPWORDS) -> Column:
    """Content words made of letters alone, after other characters became blanks."""
    return F.filter(content_words(text, stopwords), lambda w: w.rlike(r"^\p{L}+$"))


def plain_words(text: Column | str) -> Column:
    """ASCII letters and digits; other characters become blanks; stopwords and short words go."""
    stop = _listed(SCORE_STOPWORDS)
    parts = F.split(F.regexp_replace(F.lower(_text(text)), r"[^a-z0-9 \t\n\x0B\f\r]", " "), WHITE)
    return F.filter(parts, lambda w: (F.length(w) >= MIN_TOKEN) & ~F.array_contains(stop, w))


def summary(text: Column | str, n: int = SUMMARY_CHARS) -> Column:
    t = _text(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def without_stopwords(text: Column | str) -> Column:
    """Words that are no stopwords joined by blanks; the text itself if none is left."""
    stop = _listed(KEYWORD_STOPWORDS)
    kept = F.array_join(F.filter(F.regexp_extract_all(_text(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: ~F.array_contains(stop, F.lower(w))), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), _text(text))


def content_digest(text: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(_text(text).cast("binary"), 256), 1, n)


def normal_name(name: Column | str) -> Column:
    """Lower case, single blanks, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(_text(name))), r"\s+", " "), r"[^\p{L}\p{N}_ ]", "")


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """0.7 x Jaccard of the character sets + 0.3 x ratio of the lengths, of normal names; 0 if one has no character."""
    x, y = normal_name(a), normal_name(b)
    cx, cy = (F.array_distinct(F.filter(F.split(F.replace(s, F.lit(" "), F.lit("")), ""), lambda c: c != "")) for s in (x, y))
    jaccard = F.size(F.array_intersect(cx, cy)) / F.size(F.array_union(cx, cy))
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.when((F.size(cx) == 0) | (F.size(cy) == 0), F.lit(0.0)).otherwise(0.7 * jaccard + 0.3 * ratio)


def list_literal(s: Column | str) -> Column:
    """Strings of a list literal: [..], quoted as a whole or not, with bare or quoted items; a value of its own otherwise; [] if empty."""
    t = F.trim(_text(s))
    inside = F.regexp_extract(t, r"\[(.*?)\]", 1)
    items = F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", ""))
    bare = F.regexp_replace(t, r"^['\"]+|['\"]+$", "")
    return F.when(t.rlike(r"\[.*?\]"), F.filter(items, lambda x: x != "")).when(bare == "", F.array().cast("array<string>")).otherwise(F.array(bare))


def normal_answer(s: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(s)), "[^a-z0-9]", "")


def answers_match(a: Column, b: Column) -> Column:
    """One normal answer contains the other; empty ones match nothing."""
    x, y = normal_answer(a), normal_answer(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def colours_in(text: Column | str) -> Column:
    low = F.lower(_text(text))
    return F.filter(_listed(COLOURS), lambda c: F.contains(low, c))


def load_stopwords(spark, language: str = "english") -> list[str]:
    """Spark's own stopword list of a language."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(StopWordsRemover.loadDefaultStopWords(language))
