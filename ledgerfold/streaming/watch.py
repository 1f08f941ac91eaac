"""Watches over arriving rows, and windowed counts: Structured Streaming, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerfold.session import materialize, scratch_path

ALERTS = "alert string, watch string, until bigint, n bigint, acknowledged boolean"


def available(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_watches(stream: DataFrame, watches: DataFrame, key: str, label: str, threshold: str) -> DataFrame:
    """(watch, batch, n): one alert a watch and batch with at least its threshold of matching rows.

    The watches are a parameter table (user-made rules, broadcast by the planner if small); alerts have ids made of watch
    and batch, so a batch that is run twice overwrites its own.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "alerts"), scratch_path(spark, "watch-state")

    def batch(rows: DataFrame, number: int) -> None:
        hits = rows.join(watches, rows[key] == watches[label]).groupBy("watch", threshold).agg(F.count(F.lit(1)).alias("n"))
        hits.where(F.col("n") >= F.col(threshold)).select("watch", F.lit(number).cast("bigint").alias("batch"), "n").write.mode("overwrite").parquet(f"{out}/batch={number}-")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("watch string, batch bigint, n bigint").parquet(f"{out}/batch=*")


def match_watches(rows: DataFrame, watches: DataFrame, applicant: str, code: str, text: str, owner: str) -> DataFrame:
    """(watch, least, id) of rows that watches(watch, kind, value, least) match.

    Kinds: `applicant` and `keyword` by a substring whatever the case, `class` by a prefix, `competitor` by the owner's id or else
    by the name. Watches are user-made rules, few beside the rows; the planner broadcasts them if they are small.
    """
    w = watches.select("watch", "kind", F.lower("value").alias("value"), "least")
    hit = (
        ((F.col("kind") == "applicant") & F.contains(F.lower(F.coalesce(F.col(applicant), F.lit(""))), F.col("value")))
        | ((F.col("kind") == "class") & F.startswith(F.lower(F.coalesce(F.col(code), F.lit(""))), F.col("value")))
        | ((F.col("kind") == "keyword") & F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.col("value")))
        | ((F.col("kind") == "competitor") & ((F.lower(F.coalesce(F.col(owner), F.lit(""))) == F.col("value")) | F.contains(F.lower(F.coalesce(F.col(applicant), F.lit(""))), F.col("value"))))
    )
    return rows.join(w, hit).select("watch", "least", "id", "at")


def poll(rows: DataFrame, watches: DataFrame, alerts: DataFrame, until: int, applicant: str, code: str, text: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(watches, alerts) after one poll of the rows(id, at, ...) between each watch's last_checked and *until*.

    A watch whose new rows reach its threshold gives an alert with an id made of the watch and the time, so a repeated poll adds
    none; last_checked always advances.
    """
    found = match_watches(rows.where(F.col("at") <= until), watches, applicant, code, text, owner)
    new = found.join(watches.select("watch", "last_checked"), "watch").where("last_checked IS NULL OR at > last_checked")
    counts = new.groupBy("watch", "least").agg(F.count_distinct("id").alias("n")).where("n >= least")
    raised = counts.select(F.substring(F.sha2(F.concat_ws(":", "watch", F.lit(str(until))), 256), 1, 16).alias("alert"), "watch", F.lit(until).cast("bigint").alias("until"), "n", F.lit(False).alias("acknowledged"))
    alerts = materialize(alerts.unionByName(raised.join(alerts.select("alert"), "alert", "left_anti")), "alerts")
    return materialize(watches.withColumn("last_checked", F.greatest(F.coalesce("last_checked", F.lit(until)), F.lit(until)).cast("bigint")), "watches"), alerts


def acknowledge(alerts: DataFrame, ids: list[str]) -> DataFrame:
    return alerts.withColumn("acknowledged", F.col("acknowledged") | F.col("alert").isin(ids))


def delete_watch(watches: DataFrame, alerts: DataFrame, watch: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a watch: its alerts go with it."""
    return watches.where(F.col("watch") != watch), alerts.where(F.col("watch") != watch)


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """(start, key, n) of tumbling windows under a watermark; all windows that the watermark has closed."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "window-state")
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
    counted.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(out)
