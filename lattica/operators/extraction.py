"""Plug-ins for models outside the engine: extraction of entities and events from texts, and generated queries with retries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[list[str]], list[tuple[list[str], list[str]]]]
Generator = Callable[[str, str | None], str]

_NAME = re.compile("[A-Z][a-z]+(?: [A-Z][a-z]+)*")
_YEAR = re.compile("(?:1[0-9]|20)[0-9][0-9]")


def capitalised(texts: list[str]) -> list[tuple[list[str], list[str]]]:
    """The default extractor: runs of capitalised words are entities, years from 1000 to 2099 events, each in its first place only."""
    return [(list(dict.fromkeys(_NAME.findall(t))), list(dict.fromkeys(_YEAR.findall(t)))) for t in texts]


def extracted(df: DataFrame, text: str, load: Callable[[], Extractor] = lambda: capitalised, group: int = 16) -> DataFrame:
    """df with entities and events (lists of text) of a text column, in groups of `group` texts; load() makes the extractor once a worker.

    Null counts as empty, and so does a text whose group failed; columns named entities and events are replaced.
    """

    @F.pandas_udf("entities array<string>, events array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for s in batches:
            texts, rows = ["" if t is None else t for t in s], []
            for i in range(0, len(texts), group):
                part = texts[i : i + group]
                try:
                    rows += model(part)
                except Exception:  # noqa: BLE001  the extractor is foreign code
                    rows += [([], [])] * len(part)
            yield pd.DataFrame(rows, columns=["entities", "events"])

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("entities", "events")]
    return df.select(*rest, found(F.col(text)).alias("_found")).select(*rest, "_found.entities", "_found.events")


def generated(spark: SparkSession, question: str, generate: Generator, tables: dict[str, DataFrame], attempts: int = 3) -> tuple[DataFrame, int]:
    """The rows of the SQL that generate(question, last error) gives over the named tables, and the attempts it took.

    Names of tables stand in braces in the SQL. A query that doesn't analyse is asked for again, with its error; after the last attempt
    the error is raised.
    """
    error: Exception | None = None
    for attempt in range(1, attempts + 1):
        try:
            return spark.sql(generate(question, None if error is None else str(error)), **tables), attempt
        except Exception as e:  # noqa: BLE001  the query is foreign code
            error = e
    raise ValueError(f"no query after {attempts} attempts") from error
