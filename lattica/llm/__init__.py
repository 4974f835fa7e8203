"""Training-data operators: language, quality, toxicity, PII, dedup, decontamination, token counts, WARC, packing.

Nothing outside this subpackage imports it. ``lattica.llm.queries`` holds the registered queries.
"""
