"""Registered queries, by area. Importing a module registers its queries in lattica.catalog."""

from importlib import import_module

for _name in ("chunk_queries", "vector_queries", "lexical_queries", "graph_queries", "evaluation_queries", "pair_queries", "source_queries", "more_queries", "folder_queries"):
    import_module(f"{__name__}.{_name}")
