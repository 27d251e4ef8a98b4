"""All core queries and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib
import pkgutil

import idforge.plans as _plans

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "level_entropy_gini"

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("q_")):
    _module = importlib.import_module(f"idforge.plans.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
