"""Queries of problems 1 (entities across sources) and 4 (variant spellings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.llm.entities import match_records
from ledgerfold.llm.variants import name_clusters, variant_pairs

_NAMES = ("raw_name", "harmonized_name", "firm_id")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(*(table(spark, sf_dir, t) for t in ("sep_declarations", "patent_litigation", "ptab_trials", "patent_assignees")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("key_a", "key_b")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    return _matches(spark, sf_dir).select("key_a", "key_b", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "patent_assignees"), *_NAMES)


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the cluster it belongs to."""
    return name_clusters(table(spark, sf_dir, "patent_assignees"), *_NAMES).withColumnRenamed("name", "raw_name")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p4_found": p4_found, "p4_clusters": p4_clusters}
SQL: dict[str, str] = {}
