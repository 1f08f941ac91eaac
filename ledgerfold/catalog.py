"""Logical tables: names and where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "patent_research_data patent_cpc patent_assignees patent_citations firm_tech_vectors startability_surface "
    "corporate_hierarchy sep_declarations patent_litigation ptab_trials doc_labels eval_items"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one logical table; columns and filters are pushed into it by the optimizer."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Make the tables known as temporary views for `spark.sql`."""
    for name in names or TABLES:
        table(spark, root, name).createOrReplaceTempView(name)
