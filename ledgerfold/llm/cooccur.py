"""Items that appear together: pair counts and association over baskets, with large-basket blocking.

Method: baskets of up to *chunk* items give their pairs directly. A larger one is split by hash into chunks of about that
size; every chunk is repeated for each of its partners, and the two chunks of a pair meet under a key of their own, so that
the pairs of one basket are spread over all tasks. Both kinds of pairs are summed with combiners before the shuffle, and
joined with the single counts for the scores.

Defined results: items are compared in upper case without white space; null or empty items and null baskets don't count;
repeats in a basket count once; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item), items in their compared form."""
    r = rows.select(F.col(basket).alias("basket"), F.upper(F.regexp_replace(F.col(item), r"\s+", "")).alias("item"))
    return r.where("basket IS NOT NULL AND item IS NOT NULL AND item <> ''").distinct()


def _ordered_pairs(items: str) -> str:
    """SQL: the pairs i < j of a sorted array."""
    return f"flatten(transform(sequence(1, size({items}) - 1), i -> transform(slice({items}, i + 1, size({items})), y -> struct({items}[i - 1] AS a, y AS b))))"


def pair_counts(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, together) with a < b of every pair of items in a common basket."""
    sizes = members.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    n_rows, parts = members.count(), int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # baskets of more than a quarter of a task's share are at most four a task: their sizes go to all rows, the rest is joined
    fair = max(chunk, n_rows // (4 * parts))
    hot = sizes.where(F.col("size") > fair)
    marked = members.join(F.broadcast(hot), "basket", "left")
    usual = marked.where("size IS NULL").drop("size").join(sizes.where(F.col("size") <= fair), "basket")
    parts_of = marked.where("size IS NOT NULL").unionByName(usual).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    parts_of = parts_of.withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    blocks = parts_of.groupBy("basket", "chunks", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    inner = blocks.where("size(items) > 1").select(F.explode(F.expr(_ordered_pairs("items"))).alias("p"))
    split = blocks.where("chunks > 1")
    # sequence(5, 4) would count down, so the last chunk has no partners above and the first none below
    left = split.where("chunk < chunks - 1").select("basket", F.col("chunk").alias("low"), F.explode(F.expr("sequence(chunk + 1, chunks - 1)")).alias("high"), "items")
    right = split.where("chunk > 0").select("basket", F.explode(F.expr("sequence(0, chunk - 1)")).alias("low"), F.col("chunk").alias("high"), F.col("items").alias("others"))
    across = left.join(right, ["basket", "low", "high"])
    product = F.expr("flatten(transform(items, x -> transform(others, y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")
    pairs = inner.unionByName(across.select(F.explode(product).alias("p")))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("together"))


def associations(rows: DataFrame, basket: str, item: str, chunk: int = CHUNK) -> DataFrame:
    """(a, b, together, n_a, n_b, n, lift) of every pair: lift is together * n / (n_a * n_b)."""
    members = baskets(rows, basket, item)
    single = members.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    total = members.agg(F.count_distinct("basket").alias("n"))  # one row
    pairs = pair_counts(members, chunk)
    out = pairs.join(single.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a").join(single.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    out = out.join(F.broadcast(total))
    return out.withColumn("lift", F.col("together") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
