"""Vectors by position: means, decay, velocity; nearest centres; k-means within groups; similarity of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize

BLOCK = 20_000  # centres held by a task at once


def _ordered(pos: str = "pos", value: str = "m") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value])


def centroids(vectors: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """(group, centre, n): the mean vector of every group, by position, with combiners on the map side."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = vectors.select(group, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    mean = parts.groupBy(group, "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(group).agg(_ordered().alias("centre"), F.max("n").alias("n"))


def decayed_means(rows: DataFrame, owner: str, year: str, vector: str, count: str, rate: float = 0.1) -> DataFrame:
    """(owner, year, vec): the mean of all vectors up to the year, weighing sqrt(max(count, 1)) * exp(-rate * age).

    Owner-years are joined within their owner (as many as an owner has years), by position, with partial sums.
    """
    r = rows.select(owner, F.col(year).alias("y"), F.sqrt(F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(1)).cast("double")).alias("w"), F.col(vector).alias("v")).where("v IS NOT NULL")
    spread = r.select(owner, "y", "w", F.posexplode("v").alias("pos", "x"))
    years = r.select(owner, F.col("y").alias("at")).distinct()
    aged = spread.join(years, owner).where("y <= at").withColumn("k", F.col("w") * F.exp(F.lit(-rate) * (F.col("at") - F.col("y"))))
    mean = aged.groupBy(owner, "at", "pos").agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("m"))
    return mean.groupBy(owner, F.col("at").alias("year")).agg(_ordered().alias("vec"))


def velocities(rows: DataFrame, owner: str, year: str, vector: str) -> DataFrame:
    """(owner, year, velocity): length of the step from the vector of the calendar year before; null without one."""
    w = Window.partitionBy(owner).orderBy(year)
    before, last = F.lag(vector).over(w), F.lag(year).over(w)
    step = rows.select(owner, year, F.col(vector).alias("v"), before.alias("b"), last.alias("l"))
    size = F.sqrt(F.aggregate(F.zip_with("v", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return step.select(owner, year, F.when(F.col("l") == F.col(year) - 1, size).alias("velocity"))


def nearest_centroids(vectors: DataFrame, key: str, vector: str, centres: DataFrame, group: str, k: int) -> DataFrame:
    """(key, group, similarity, rank) of the k nearest centres by cosine, 0 for a vector of length 0; ties by group.

    Centres are counted and taken in blocks of bounded size; every block is a matrix product an Arrow batch, of which the
    best k stay, so no vector meets the centres as rows.
    """
    c = centres.select(F.col(group).cast("string").alias("g"), "centre")
    n = c.count()
    blocks = max(1, -(-n // BLOCK))
    kinds = (vectors.schema[key].dataType.simpleString(), centres.schema[group].dataType.simpleString())
    found = None
    for b in range(blocks):
        part = c.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        part = part.sort_values("g", key=lambda s: s.astype(float) if kinds[1] != "string" else s).reset_index(drop=True)
        names, m = part["g"].to_numpy(object), np.stack(part["centre"].map(np.asarray).to_list()).astype(float)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def run(frames: Iterator[pd.DataFrame], names: np.ndarray = names, m: np.ndarray = m) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                x = np.stack([np.asarray(v, float) for v in f[vector]])
                s = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ m.T, 6)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"key": np.repeat(f[key].to_numpy(), top.shape[1]), "g": names[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()})

        one = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"key {kinds[0]}, g string, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.select(F.col(key), F.lit(None).cast(kinds[1]).alias(group), F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("rank")).limit(0)
    found = found.select(F.col("key").alias(key), F.col("g").cast(kinds[1]).alias(group), "similarity")
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), group)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kmeans_in_groups(vectors: DataFrame, group: str, key: str, vector: str, most: int = 5, rounds: int = 6) -> DataFrame:
    """(group, key, cluster, k, silhouette): Lloyd's k-means of all groups at once; k from 2 to *most* by the best silhouette.

    Every round joins the vectors with the centres of their group (k rows a group) and averages by position, so a group of any
    size is spread over all tasks. Silhouettes are measured against centres: (b - a) / max(a, b) of the two nearest ones.
    Groups of fewer than three vectors are one cluster.
    """
    v = materialize(vectors.select(F.col(group).alias("g"), F.col(key).cast("string").alias("key"), F.col(vector).alias("v")).where("g IS NOT NULL AND v IS NOT NULL"), "kmeans-vectors")
    gap = F.aggregate(F.zip_with("v", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = None
    for k in range(2, most + 1):
        first = v.withColumn("c", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("key"), "key"))).where(F.col("c") <= k)
        centres = materialize(first.select("g", "c", F.col("v").alias("centre")), f"kmeans-{k}")
        for r in range(rounds + 1):
            near = v.join(centres, "g").withColumn("d", gap).groupBy("g", "key").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("near"))
            if r == rounds:
                break
            placed = near.select("g", "key", F.col("near")[0]["c"].alias("c")).join(v, ["g", "key"])
            mean = placed.select("g", "c", F.posexplode("v").alias("pos", "x")).groupBy("g", "c", "pos").agg(F.avg("x").alias("m"))
            centres = materialize(mean.groupBy("g", "c").agg(_ordered().alias("centre")), f"kmeans-{k}-{r}")
        a, b = F.sqrt(F.col("near")[0]["d"]), F.sqrt(F.get("near", F.lit(1))["d"])
        s = F.when(F.size("near") > 1, F.try_divide(b - a, F.greatest(a, b)))
        one = near.select("g", "key", F.col("near")[0]["c"].alias("cluster"), F.lit(k).alias("k"), F.coalesce(s, F.lit(0.0)).alias("s"))
        best = one if best is None else best.unionByName(one)
    best = materialize(best, "kmeans-all")
    score = best.groupBy("g", "k").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy(F.desc("silhouette"), "k")
    chosen = score.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("g", "k", "silhouette", "n")
    out = best.join(chosen, ["g", "k"])
    return out.select(F.col("g").alias(group), F.col("key"), F.when(F.col("n") < 3, 1).otherwise(F.col("cluster")).alias("cluster"), F.when(F.col("n") < 3, 1).otherwise(F.col("k")).alias("k"), "silhouette")


def set_similarity(members: DataFrame, owner: str, item: str, target) -> DataFrame:
    """(owner, shared, jaccard) of every other owner's items with those of one target."""
    m = members.select(owner, item).distinct()
    mine = m.where(F.col(owner) == F.lit(target)).select(item)
    count = mine.count()
    size = m.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    shared = m.join(mine, item).groupBy(owner).agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(size, owner).where(F.col(owner) != F.lit(target))
    return out.select(owner, "shared", F.round(F.col("shared") / (F.col("n") + F.lit(count) - F.col("shared")), 6).alias("jaccard"))
