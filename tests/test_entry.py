import importlib
import sys

import __spark_entry__


def test_queries_and_oracles_go_together():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "k1_graph_expanded_retrieval" in __spark_entry__.queries()


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lattica.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lattica.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
