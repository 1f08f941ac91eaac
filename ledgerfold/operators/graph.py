"""Graph operators on edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize


def bfs(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", per_node: int | None = None) -> DataFrame:
    """(node, level) reached from start(node) in up to *depth* steps over edges(src, dst).

    Every level is one join of the frontier with the edges, without those visited. With *per_node* only the smallest
    so many neighbours of a node are followed.
    """
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    steps = {"out": one, "in": back, "both": one.unionByName(back)}[direction].where("node <> to").distinct()
    if per_node:
        steps = steps.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("to"))).where(F.col("rn") <= per_node).drop("rn")
    seen = materialize(start.select("node").distinct().withColumn("level", F.lit(0)), "bfs-0")
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select("node").join(steps, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(reached.withColumn("level", F.lit(level)), f"bfs-{level}")
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges(src, dst); the component is its smallest node.

    Large-star and small-star rounds on (node, smaller node) rows, until nothing changes: a node's neighbours are only ever
    reduced to their minimum, never gathered, and a chain takes about as many rounds as its length has binary digits.
    """
    links = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "components")
    before, turn = None, 0
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = materialize(small, f"components-{turn}")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, turn = state, turn + 1
    tops = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient): every triangle is found once, from its edge order by degree."""
    und = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    both = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    up = ranked.where("d < e OR d = e AND a < b").select("a", "b")  # from the smaller degree: no hub opens all its pairs
    wedge = up.join(up.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedge.join(und.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("t"))
    out = degree.join(per, "a", "left").select(F.col("a").alias("node"), F.col("d").alias("degree"), F.coalesce("t", F.lit(0)).alias("triangles"))
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)))


def bfs_edges(edges: DataFrame, start: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """(src, dst, level): the edges met on the way from start(node), each at its first level and once.

    With *per_node* only so many neighbours of a node, the smallest first, are followed.
    """
    seen = bfs(edges, start, depth, "both", per_node)
    e = edges.select("src", "dst").where("src <> dst").distinct()
    at = e.join(seen.select(F.col("node").alias("src"), F.col("level").alias("l1")), "src", "left").join(seen.select(F.col("node").alias("dst"), F.col("level").alias("l2")), "dst", "left")
    level = F.least(F.coalesce("l1", F.lit(depth)), F.coalesce("l2", F.lit(depth))) + 1
    return at.where("l1 IS NOT NULL AND l2 IS NOT NULL").select("src", "dst", level.alias("level")).where(F.col("level") <= depth)


def path_lengths(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, hops) of all nodes within *hops* undirected steps of sources(node); all sources advance together."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct(), "paths-0")
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select("source", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(h)), f"paths-{h}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def label_propagation(edges: DataFrame, sweeps: int) -> DataFrame:
    """(node, label) after synchronous sweeps: every node takes the most frequent label around it, the smallest of equals.

    Labels start as the nodes themselves. All nodes change at once, so the result doesn't depend on any order.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "labels-edges")
    label = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "label")
    for sweep in range(sweeps):
        votes = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        label = materialize(votes.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("src").alias("node"), "label"), f"labels-{sweep}")
    return label


def percolation(edges: DataFrame, shares: list[float]) -> DataFrame:
    """(share, removed, largest): size of the largest component once the nodes of highest degree are taken away, by share."""
    e = materialize(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "percolation-edges")
    degree = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    n = degree.count()
    out = None
    for share in shares:
        k = int(share * n)
        gone = degree.orderBy(F.desc("d"), "node").limit(k).select("node")
        left = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        size = components(left).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0 if k >= n else 1)).alias("largest"))
        row = size.select(F.lit(share).alias("share"), F.lit(k).cast("bigint").alias("removed"), F.col("largest").cast("bigint").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def small_world(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(clustering, path_length, density, index) of an undirected graph, path lengths measured from the sources.

    index = (clustering / density) / (path_length / (ln n / ln mean degree)).
    """
    t = triangles(edges).agg(F.avg("coefficient").alias("clustering"), F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean_degree"))
    p = path_lengths(edges, sources, hops).where("hops > 0").agg(F.avg("hops").alias("path_length"))
    both = t.crossJoin(F.broadcast(p)).withColumn("density", F.col("mean_degree") / (F.col("n") - 1))  # one row each
    index = F.try_divide(F.try_divide(F.col("clustering"), F.col("density")), F.try_divide(F.col("path_length"), F.log("n") / F.log("mean_degree")))
    return both.select("clustering", "path_length", "density", index.alias("index"))
