"""Queries of problems 9 (leaked test items) and 10 (abusive texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.llm.leakage import find_leaks
from ledgerfold.llm.toxicity import score_documents, train


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every leaked test item: in how many documents and sources it stands."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.select("doc_id", "source").distinct()
    return p9_found(spark, sf_dir).join(sources, "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source").alias("n_sources"))


TOXIC = 0.1  # the prior of toxic sentences is below a hundredth, so a tenth is far above what other texts score


def _scored(spark: SparkSession, sf_dir: str, floor: float = 0.0) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = train(docs, "doc_id", "text", table(spark, sf_dir, "doc_labels"), "doc_id", "toxic")
    return score_documents(docs, "doc_id", "text", scorer, "source", floor=floor)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, TOXIC).where(F.col("doc_id").isNotNull() & (F.col("score") >= TOXIC)).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source the number and the rate of abusive documents."""
    toxic = (F.col("score") >= TOXIC).cast("int")
    return _scored(spark, sf_dir, TOXIC).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(toxic).alias("n_toxic"), F.round(F.avg(toxic), 6).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources, "p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
