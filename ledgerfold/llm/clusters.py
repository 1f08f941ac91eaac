"""Average-linkage clusters of sparse similarity graphs.

Components of up to *limit* nodes are merged within a task, many at once; larger ones by rounds of merging mutual best pairs
of clusters over the whole cluster (average linkage is reducible, so both give the merges of the sequential algorithm). A
pair without an edge has similarity 0. Nodes weigh as many as the rows they stand for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.graph import components
from ledgerfold.session import materialize

EDGES_PER_TASK = 20_000


def linkage(n: int, weight: np.ndarray, ia: np.ndarray, ib: np.ndarray, sim: np.ndarray, cut: float) -> np.ndarray:
    """Average linkage of n nodes: the label (smallest position) of every node. Ties: the pair of smaller positions."""
    total: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, s in zip(ia.tolist(), ib.tolist(), sim.tolist()):
        v = max(total[a].get(b, 0.0), s * weight[a] * weight[b])
        total[a][b] = total[b][a] = v
    size = weight.astype(float).tolist()
    members = [[i] for i in range(n)]
    heap = [(-s / (size[a] * size[b]), a, b) for a in range(n) for b, s in total[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        value, a, b = heapq.heappop(heap)
        if -value < cut:
            break
        if b not in total[a] or -value != total[a][b] / (size[a] * size[b]):  # merged or weighed anew since
            continue
        size[a] += size[b]
        del total[a][b]
        for c, s in total[b].items():
            if c != a:
                total[a][c] = total[c][a] = total[a].get(c, 0.0) + s
                del total[c][b]
        total[b] = {}
        members[a] += members[b]
        members[b] = []
        for c, s in total[a].items():
            heapq.heappush(heap, (-s / (size[a] * size[c]), min(a, c), max(a, c)))
    label = np.arange(n)
    for a, own in enumerate(members):
        label[own] = a
    return label


def _local(cut: float):
    """The clusters of all components of a task at once: components share no edge, so each merges as if it were alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        f = pd.concat(parts, ignore_index=True)
        names, at = np.unique(np.r_[f["a"].to_numpy(object), f["b"].to_numpy(object)].astype(object), return_inverse=True)
        ia, ib = at[: len(f)], at[len(f) :]
        weight = np.ones(len(names))
        weight[ia], weight[ib] = f["wa"].to_numpy(), f["wb"].to_numpy()
        yield pd.DataFrame({"node": names, "cluster": names[linkage(len(names), weight, ia, ib, f["sim"].to_numpy(), cut)]})

    return run


def _mutual(edges: DataFrame, cut: float) -> DataFrame:
    """The same clusters by rounds of mutual best merges, without gathering a component."""
    nodes = edges.select(F.col("a").alias("node"), F.col("wa").alias("w")).unionByName(edges.select(F.col("b").alias("node"), F.col("wb").alias("w"))).groupBy("node").agg(F.max("w").alias("w"))
    label = materialize(nodes.select("node", F.col("node").alias("cluster"), "w"), "linkage-labels")
    links = materialize(edges.select("a", "b", (F.col("sim") * F.col("wa") * F.col("wb")).alias("s")), "linkage-links")
    while True:
        size = label.groupBy("cluster").agg(F.sum("w").alias("size"))
        scored = links.join(size.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b").select("a", "b", (F.col("s") / (F.col("sa") * F.col("sb"))).alias("m")).where(F.col("m") >= cut)
        order = F.struct((-F.col("m")).alias("o"), "a", "b")
        best = scored.select(F.col("a").alias("c"), order.alias("k")).unionByName(scored.select(F.col("b").alias("c"), order.alias("k"))).groupBy("c").agg(F.min("k").alias("k"))
        pairs = best.groupBy("k").count().where("count = 2").select(F.col("k.a").alias("to"), F.col("k.b").alias("cluster"))
        pairs = materialize(pairs, "linkage-pairs")
        if pairs.isEmpty():
            return label.select("node", "cluster")
        label = materialize(label.join(pairs, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"), "w"), "linkage-labels")
        moved = links.join(pairs.select(F.col("cluster").alias("a"), F.col("to").alias("ta")), "a", "left").join(pairs.select(F.col("cluster").alias("b"), F.col("to").alias("tb")), "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "s").where("x <> y")
        links = materialize(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "linkage-links")


def average_linkage(edges: DataFrame, cut: float, limit: int = 2000) -> DataFrame:
    """(node, cluster) for the nodes of edges(a, b, sim, wa, wb); the cluster is its smallest node."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "sim", F.when(F.col("a") < F.col("b"), F.col("wa")).otherwise(F.col("wb")).alias("wx"), F.when(F.col("a") < F.col("b"), F.col("wb")).otherwise(F.col("wa")).alias("wy"))
    e = materialize(e.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("sim").alias("sim"), F.max("wx").cast("double").alias("wa"), F.max("wy").cast("double").alias("wb")), "linkage-edges")
    comp = materialize(components(e.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "linkage-components")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = e.join(comp.withColumnRenamed("node", "a"), "a").join(size, "component")
    tasks = max(1, -(-e.count() // EDGES_PER_TASK))
    small = placed.where(F.col("n") <= limit).select("component", "a", "b", "sim", "wa", "wb").repartition(tasks, "component").mapInPandas(_local(cut), "node string, cluster string")
    large = materialize(placed.where(F.col("n") > limit).drop("component", "n"), "linkage-large")
    return small if large.isEmpty() else small.unionByName(_mutual(large, cut))
