"""Queries of the general problems 2 (hierarchies) and 6 (a few keys holding most rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.operators.hierarchy import descendants, hierarchy_paths, resolve_hierarchy
from ledgerfold.operators.skew import eager_join_aggregate, heavy_keys
from ledgerfold.session import materialize

_HIERARCHY = ("firm_id", "parent_firm_id", "ownership_pct")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_hierarchy(table(spark, sf_dir, "corporate_hierarchy"), *_HIERARCHY)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every firm of a tree with its path from the root and the number of firms below it."""
    paths = materialize(hierarchy_paths(table(spark, sf_dir, "corporate_hierarchy"), *_HIERARCHY), "paths")
    below = descendants(paths).groupBy("firm_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    out = paths.join(below, "firm_id", "left")
    return out.select("firm_id", F.array_join("path", "/").alias("path"), "depth", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(hierarchy_paths(table(spark, sf_dir, "corporate_hierarchy"), *_HIERARCHY))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "patent_citations").select(F.lit("patent_citations").alias("table_name"), F.col("citing_publication").alias("key_value"))
    owned = table(spark, sf_dir, "patent_assignees").select(F.lit("patent_assignees").alias("table_name"), F.col("firm_id").alias("key_value"))
    return heavy_keys(cited.unionByName(owned), "table_name", "key_value", 0.02).select("table_name", "key_value")


def p6_firm_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations made by the publications of every firm: assignees joined with citations, never row by row."""
    owned = table(spark, sf_dir, "patent_assignees").where("firm_id IS NOT NULL")
    cited = table(spark, sf_dir, "patent_citations")
    out = eager_join_aggregate(owned, cited, ["publication_number"], ["citing_publication"], ["firm_id"], [])
    return out.select(F.col("left_firm_id").alias("firm_id"), F.col("n_pairs").alias("n_citations"), F.col("n_left_rows").alias("n_owner_rows"))


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p6_found": p6_found, "p6_firm_citations": p6_firm_citations}

_CHOSEN = r"""
WITH RECURSIVE cleaned AS (
  SELECT lower(regexp_replace(firm_id, '^\s+|\s+$', '', 'g')) AS node, lower(regexp_replace(parent_firm_id, '^\s+|\s+$', '', 'g')) AS parent, CASE WHEN isnan(ownership_pct) THEN NULL ELSE ownership_pct END AS w
  FROM corporate_hierarchy WHERE firm_id IS NOT NULL),
valid AS (SELECT * FROM cleaned WHERE parent IS NOT NULL AND parent <> '' AND parent <> node),
best AS (SELECT node, parent FROM (SELECT node, parent, row_number() OVER (PARTITION BY node ORDER BY w DESC NULLS LAST, parent) AS rn FROM valid) WHERE rn = 1),
nodes AS (SELECT DISTINCT node FROM cleaned WHERE node <> ''),
links AS (SELECT n.node, b.parent FROM nodes n LEFT JOIN best b ON n.node = b.node)
"""
_WALK = _CHOSEN + r""",
tops AS (SELECT node FROM links WHERE parent IS NULL UNION SELECT DISTINCT parent FROM links WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM nodes)),
tree AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM tops
  UNION ALL
  SELECT l.node, t.root, t.depth + 1, t.path || '/' || l.node FROM links l JOIN tree t ON l.parent = t.node)
"""

SQL = {
    "p2_found": _WALK
    + r""",
ring AS (
  SELECT node AS first_node, parent AS cur FROM links WHERE parent IS NOT NULL AND node NOT IN (SELECT node FROM tree)
  UNION
  SELECT r.first_node, l.parent FROM ring r JOIN links l ON r.cur = l.node)
SELECT n.node AS firm_id, coalesce(t.root, '') AS root_firm_id, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth,
  CASE WHEN t.node IS NOT NULL THEN 'tree' WHEN n.node IN (SELECT first_node FROM ring WHERE first_node = cur) THEN 'cycle' ELSE 'under_cycle' END AS node_state
FROM nodes n LEFT JOIN tree t ON n.node = t.node""",
    "p2_paths": _WALK
    + r"""
SELECT t.node AS firm_id, t.path, CAST(t.depth AS BIGINT) AS depth,
  (SELECT count(*) FROM tree d JOIN nodes m ON d.node = m.node WHERE list_contains(string_split(d.path, '/'), t.node) AND d.node <> t.node) AS n_descendants
FROM tree t JOIN nodes n ON t.node = n.node""",
    "p2_descendants": _WALK
    + r"""
SELECT u.firm_id, u.descendant, CAST(u.depth - u.i + 1 AS BIGINT) AS steps
FROM (SELECT node AS descendant, depth, unnest(string_split(path, '/')) AS firm_id, unnest(range(1, depth + 2)) AS i FROM tree WHERE node IN (SELECT node FROM nodes)) u
WHERE u.firm_id <> u.descendant""",
    "p6_found": """
SELECT 'patent_citations' AS table_name, citing_publication AS key_value FROM patent_citations WHERE citing_publication IS NOT NULL
GROUP BY citing_publication HAVING count(*) >= 0.02 * (SELECT count(*) FROM patent_citations)
UNION ALL
SELECT 'patent_assignees', firm_id FROM patent_assignees WHERE firm_id IS NOT NULL
GROUP BY firm_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM patent_assignees)""",
    "p6_firm_citations": """
WITH c AS (SELECT citing_publication AS pub, count(*) AS n FROM patent_citations WHERE citing_publication IS NOT NULL GROUP BY 1),
a AS (SELECT publication_number AS pub, firm_id, count(*) AS n FROM patent_assignees WHERE firm_id IS NOT NULL AND publication_number IS NOT NULL GROUP BY 1, 2)
SELECT firm_id, CAST(sum(a.n * c.n) AS BIGINT) AS n_citations, CAST(sum(a.n) AS BIGINT) AS n_owner_rows FROM a JOIN c USING (pub) GROUP BY firm_id""",
}
