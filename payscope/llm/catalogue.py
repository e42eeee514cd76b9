"""The queries of the subpackage: each module lists its own in QUERIES and ORACLE_SQL."""

from __future__ import annotations

import importlib

MODULES = ["sharding", "ann_tree", "mixing", "ngram_trie", "packing", "simhash", "toxicity", "warc", "quality", "licences",
           "fill_middle", "token_counts", "filter_audit"]


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"payscope.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
