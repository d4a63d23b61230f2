"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = (
    "op1_language",
    "op2_suffix",
    "op3_fingerprints",
    "op4_mixing",
    "op5_bpe",
    "op6_simhash",
    "op7_substrings",
    "op8_urls",
    "op9_embeddings",
    "op10_quality",
)

_found = [importlib.import_module(f"meterflow.llm.{m}") for m in MODULES]
QUERIES = {k: f for m in _found for k, f in m.QUERIES.items()}
SQL = {k: s for m in _found for k, s in m.SQL.items()}
