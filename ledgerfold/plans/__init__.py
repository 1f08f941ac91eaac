"""Registered queries: modules with QUERIES (name -> callable(spark, dir)) and SQL (name -> oracle text)."""

from __future__ import annotations

import importlib

MODULES = ["relational", "analytic", "core_problems", "domain", "pipeline"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"ledgerfold.plans.{name}")
        clash = set(queries) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
