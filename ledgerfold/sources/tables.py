"""Sources and sinks of the batch layer: header synonyms, nested rows, tolerant lists, resumable loads; upsert, insert-or-ignore,
partition replace, bulk load, exports, hash chain."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Source(Protocol):
    """What a source offers: rows of a table, and rows that are newer than a mark."""

    def read(self, spark: SparkSession) -> DataFrame: ...

    def read_since(self, spark: SparkSession, mark: int) -> DataFrame: ...


class ParquetSource:
    """Parquet files with a column that grows; the filter on it reaches the scan."""

    def __init__(self, path: str, mark: str) -> None:
        self.path, self.mark = path, mark

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read_since(self, spark: SparkSession, mark: int | None) -> DataFrame:
        rows = self.read(spark)
        return rows if mark is None else rows.where(F.col(self.mark) > mark)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The old rows with the new ones put in; of several new rows of a key the last by *order* counts, then by all columns."""
    ties = [F.col(c).desc_nulls_last() for c in new.columns if c not in (*keys, order)]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *ties)
    latest = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def upsert_with_children(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Parents upserted; the children of every parent that came are replaced by those that came with it, null keys dropped."""
    came = new_parents.where(F.col(key).isNotNull())
    kept = children.join(came.select(key).distinct(), key, "left_anti")
    fresh = new_children.join(came.select(key).distinct(), key, "left_semi")
    return upsert(parents, came, [key], order), kept.unionByName(fresh)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one a key: what is to be appended."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def bulk_insert(df: DataFrame, path: str, by: str) -> None:
    """Write partitioned files at once, clustered so that every partition is a few large files."""
    df.repartition(F.col(by)).sortWithinPartitions(by).write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that *df* has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report as CSV with a header, or as JSON lines."""
    df.write.mode("overwrite").options(header=True).format({"csv": "csv", "json": "json"}[kind]).save(path)


def load_new(source: Source, spark: SparkSession, log: DataFrame, name: str, path: str, mark: str) -> DataFrame:
    """Append what is newer than the last completed load of *name* in log(source, mark, rows) and give the log's new row.

    Nothing is appended twice: the mark is that of the rows written, and a load without new rows logs none.
    """
    last = log.where(F.col("source") == name).agg(F.max("mark")).first()[0]
    rows = source.read_since(spark, last)
    top = rows.agg(F.max(mark).cast("bigint").alias("mark"), F.count(F.lit(1)).alias("rows")).first()
    if top["rows"]:
        rows.where(F.col(mark) <= top["mark"]).write.mode("append").parquet(path)
    entry = [(name, top["mark"], top["rows"])] if top["rows"] else []
    return spark.createDataFrame(entry, "source string, mark bigint, rows bigint")


def read_csv(spark: SparkSession, path: str, names: dict[str, list[str]]) -> DataFrame:
    """A CSV with a header whose columns go by one of several names."""
    raw = spark.read.option("header", True).csv(path)
    there = {c.strip().lower(): c for c in raw.columns}
    picked = []
    for out, options in names.items():
        found = [F.col(f"`{there[o.lower()]}`") for o in options if o.lower() in there]
        picked.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(out))
    return raw.select(*picked)


def company_master(rows: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, name, n) of a master list: names of one key once, under the first by the alphabet."""
    return rows.select(F.col(name).alias("name"), key.alias("key")).where("key <> ''").groupBy("key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))


def text_list(col: Column) -> Column:
    """A list that may be JSON or parts between semicolons, commas or bars; an empty one where nothing can be read."""
    t = F.trim(F.coalesce(col, F.lit("")))
    parts = F.filter(F.transform(F.split(t, r"\s*[;,|]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.startswith(t, F.lit("[")), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(parts)


def explode_nested(rows: DataFrame, key: str, nested: str) -> DataFrame:
    """(key, pos, item) of a nested column; rows without items give none."""
    return rows.select(key, F.posexplode(nested).alias("pos", "item"))


def audit_chain(events: DataFrame, task: str, order: str, payload: str) -> DataFrame:
    """(task, head): the hash chain over a task's events in order, folded inside the JVM.

    A chain is sequential by its nature, so a task's events meet in one place; tasks are call logs of bounded length.
    """
    ordered = events.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).cast("string").alias("p")))).alias("e"))
    return ordered.select(task, F.aggregate("e", F.lit(""), lambda acc, e: F.sha2(F.concat(acc, F.lit("|"), F.coalesce(e["p"], F.lit(""))), 256)).alias("head"))
