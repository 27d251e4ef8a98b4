"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _name in ("near_dup", "splits", "format_dup", "chunking", "cross_split", "leakage", "mixing", "mojibake"):
    _m = importlib.import_module(f"idforge.llm.q_{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
