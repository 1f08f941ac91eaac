"""Queries of problem 5 (most similar vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.llm.knn import nearest

_FIRM = "concat(firm_id, ':', cast(year as string))"


def _pairs(found: DataFrame, space: str) -> DataFrame:
    return found.select(F.lit(space).alias("space"), F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    patents = nearest(table(spark, sf_dir, "patent_research_data"), "publication_number", "publication_number", "embedding_v1", 3, 0.95)
    firms = nearest(table(spark, sf_dir, "firm_tech_vectors"), _FIRM, "firm_id", "tech_vector", 3, 0.95)
    return _pairs(patents, "patent").unionByName(_pairs(firms, "firm"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of a twentieth of the publications (by hash of the key) among all, whatever their cosine; recall 0.95."""
    found = nearest(table(spark, sf_dir, "patent_research_data"), "publication_number", "publication_number", "embedding_v1", 10, recall=0.95, every=20)
    return found.select(F.col("key").alias("publication_number"), "neighbour", "cosine", F.col("rank").cast("bigint").alias("rank"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
_VALID = "v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_SPACE = """
{0}_v AS (SELECT key, any_value(grp) AS grp, any_value(v) AS v FROM (SELECT {1} AS key, {2} AS grp, {3}::DOUBLE[] AS v FROM {4}) WHERE key IS NOT NULL AND """ + _VALID + """ GROUP BY key),
{0}_s AS (SELECT a.key AS key, b.key AS other, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM {0}_v a JOIN {0}_v b ON a.grp <> b.grp WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.95),
{0}_t AS (SELECT key, other FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, other) AS rn FROM {0}_s) WHERE rn <= 3)"""
SQL: dict[str, str] = {
    "p5_found": "WITH "
    + _SPACE.format("p", "publication_number", "publication_number", "embedding_v1", "patent_research_data")
    + ", "
    + _SPACE.format("f", "firm_id || ':' || year", "firm_id", "tech_vector", "firm_tech_vectors")
    + """
SELECT DISTINCT 'patent' AS space, least(key, other) AS key_a, greatest(key, other) AS key_b FROM p_t UNION ALL SELECT DISTINCT 'firm', least(key, other), greatest(key, other) FROM f_t"""
}
