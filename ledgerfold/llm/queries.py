"""Queries of the problems tagged llm; a module is left out of the registry only by being left out of the list."""

from __future__ import annotations

import importlib

MODULES = ["q_tables", "q_vectors", "q_names", "q_texts"]
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"ledgerfold.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
