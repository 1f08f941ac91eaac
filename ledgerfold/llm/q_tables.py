"""Queries of problems 3 (top N), 7 (items together) and 8 (containers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.llm.cooccur import associations
from ledgerfold.llm.packing import TOKENIZER, pack, token_counts
from ledgerfold.llm.topn import top_n

CAPACITY = 2048


def _top(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return top_n(table(spark, sf_dir, "startability_surface"), "firm_id", "cluster_id", "year", "score", "ingested_at", n)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 5).select(F.col("grp").alias("firm_id"), F.col("item").alias("cluster_id"), "year")


def p3_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 20).select(F.col("grp").alias("firm_id"), F.col("rank").cast("bigint").alias("rank"), F.col("item").alias("cluster_id"), "year", "score")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = associations(table(spark, sf_dir, "patent_cpc"), "publication_number", "cpc_code")
    return a.where("together >= 5 AND together * n >= 4 * n_a * n_b").select(F.col("a").alias("code_a"), F.col("b").alias("code_b"))


def p7_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = associations(table(spark, sf_dir, "patent_cpc"), "publication_number", "cpc_code")
    return a.where("together >= 5").select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "together", F.round("lift", 6).alias("lift"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container; capacity in tokens of a byte-level BPE of 50,257 ids."""
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get("ledgerfold.tokenizer", TOKENIZER)), CAPACITY)


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed; containers over the capacity, and documents split that fit into one: none of either."""
    pieces = p8_containers(spark, sf_dir)
    over = pieces.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count(F.when(F.col("t") > CAPACITY, 1)).alias("over_capacity"))
    items = pieces.groupBy("item").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("t") <= CAPACITY) & (F.col("n") > 1), 1)).alias("split_in_vain"))
    return items.crossJoin(F.broadcast(over)).select("documents", "over_capacity", "split_in_vain")  # one row each


QUERIES = {"p3_found": p3_found, "p3_top20": p3_top20, "p7_found": p7_found, "p7_associations": p7_associations, "p8_containers": p8_containers, "p8_summary": p8_summary}

_LAST = """
WITH last_rows AS (
  SELECT firm_id, cluster_id, year, score FROM startability_surface WHERE firm_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY firm_id, cluster_id, year ORDER BY ingested_at DESC NULLS LAST, score DESC NULLS LAST) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY score DESC, year DESC NULLS LAST, cluster_id NULLS FIRST) AS rank
  FROM last_rows WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1)
"""
_PAIRS = r"""
WITH members AS (
  SELECT DISTINCT publication_number AS p, upper(regexp_replace(cpc_code, '\s+', '', 'g')) AS c FROM patent_cpc
  WHERE publication_number IS NOT NULL AND cpc_code IS NOT NULL AND regexp_replace(cpc_code, '\s+', '', 'g') <> ''),
single AS (SELECT c, count(*) AS n FROM members GROUP BY c),
total AS (SELECT count(DISTINCT p) AS n FROM members),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS t FROM members x JOIN members y ON x.p = y.p AND x.c < y.c GROUP BY ALL)
"""
SQL = {
    "p8_summary": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS split_in_vain FROM documents WHERE text IS NOT NULL AND text <> ''",
    "p3_found": _LAST + "SELECT firm_id, cluster_id, year FROM ranked WHERE rank <= 5",
    "p3_top20": _LAST + "SELECT firm_id, rank, cluster_id, year, score FROM ranked WHERE rank <= 20",
    "p7_found": _PAIRS + "SELECT a AS code_a, b AS code_b FROM pairs JOIN single sa ON sa.c = a JOIN single sb ON sb.c = b, total WHERE t >= 5 AND t * total.n >= 4 * sa.n * sb.n",
    "p7_associations": _PAIRS + "SELECT a AS code_a, b AS code_b, t AS together, round(t * total.n / (sa.n::DOUBLE * sb.n), 6) AS lift FROM pairs JOIN single sa ON sa.c = a JOIN single sb ON sb.c = b, total WHERE t >= 5",
}
