"""Queries declared once as SQL over logical tables; Catalyst plans them, DuckDB checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.catalog import TABLES, register

#: Role bindings: how the record, class, owner and citation roles are filled from the order tables.
ROLES = {
    "records": "SELECT o_orderkey AS id, o_custkey AS family, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(o_orderdate AS DATE) AS d, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "codes": "SELECT DISTINCT l_orderkey AS id, p_brand AS code, p_type AS section FROM lineitem JOIN part ON l_partkey = p_partkey",
    "owners": "SELECT DISTINCT l_orderkey AS id, l_suppkey AS firm FROM lineitem",
    "cites": "SELECT id AS citing, prev AS cited FROM (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL",
    "momentum": "SELECT code, y, n, n - lag(n) OVER (PARTITION BY code ORDER BY y) AS up, lag(n) OVER (PARTITION BY code ORDER BY y) AS before FROM (SELECT p_brand AS code, CAST(year(l_shipdate) AS INT) AS y, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "surface": "SELECT firm_id, cluster_id, year, max(score) AS score FROM startability_surface WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND firm_id IS NOT NULL GROUP BY firm_id, cluster_id, year",
}


def with_roles(body: str) -> str:
    """The body behind the common table expressions of the roles it names."""
    used = [r for r in ROLES if re.search(rf"\b{r}\b", body)]
    heads = [f"{r} AS ({ROLES[r]})" for r in used]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if not heads:
        return body
    if own:
        return f"WITH {own.group(1) or ''}{', '.join(heads)}, {body[own.end() :]}"
    return f"WITH {', '.join(heads)} {body}"


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    # Spark reads 1.0 as a decimal of two digits; the analytic scores are doubles
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, names)
        return spark.sql(text)

    return run


def declare(bodies: dict[str, str]) -> tuple[dict, dict]:
    texts = {name: with_roles(body) for name, body in bodies.items()}
    return {n: query(t) for n, t in texts.items()}, texts
