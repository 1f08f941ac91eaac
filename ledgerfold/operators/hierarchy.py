"""Parent-child links to full hierarchies.

Method: every partition contracts the parent chains that lie inside it to the point where they leave it (the fragment
exit). The exits that other partitions point at form a smaller quotient forest, which is solved the same way, again and
again, until it fits one partition. Its solution is then expanded back over the fragments. A cycle inside a partition
shows in the local step, one across partitions in the quotient; the nodes on it are those on the fragment paths between
the quotient nodes that lie on it.

Shrinking: half of the nodes (by hash) are moved to the partition of their parent, so also a single long chain loses a
quarter of its nodes a round on average; leaves go at once. Parents with more children than a share of a partition draw
no child to them, so no partition grows with the fan-out of a hot parent.

Defined results: ids are compared trimmed and in lower case; rows with a null or blank child are ignored; a null or blank
parent, or the child itself, is no parent; NaN ownership counts as null; repeated rows change nothing; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.skew import join_hot
from ledgerfold.session import materialize

ROWS_PER_PARTITION = 50_000
TREE, CYCLE, UNDER = 1, 2, 3
_LINKS = "node string, next string, steps bigint, state int, root string"


def clean_id(col):
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def choose_parent(rows: DataFrame, child: str, parent: str, weight: str | None = None) -> DataFrame:
    """(node, parent) with one row a child: the parent of the greatest weight in any row, then the smaller id."""
    r = rows.select(clean_id(F.col(child)).alias("node"), clean_id(F.col(parent)).alias("parent"), (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("w"))
    r = r.where(F.col("node").isNotNull() & (F.col("node") != ""))
    valid = F.col("parent").isNotNull() & (F.col("parent") != "") & (F.col("parent") != F.col("node"))
    order = F.when(F.col("w").isNull() | F.isnan("w"), F.lit(float("inf"))).otherwise(-F.col("w"))
    best = F.min(F.when(valid, F.struct(order.alias("o"), F.col("parent").alias("p"))))
    return r.groupBy("node").agg(best.alias("b")).select("node", F.col("b.p").alias("parent"))


def _index(nodes: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Position of each target among nodes, -1 where it isn't there."""
    at = pd.Index(nodes).get_indexer(targets)
    at[pd.isna(targets)] = -1
    return at


def _contract(frame: pd.DataFrame) -> pd.DataFrame:
    """Follow all chains of one partition at once by pointer doubling."""
    n = len(frame)
    nodes, nxt = frame["node"].to_numpy(object), frame["next"].to_numpy(object)
    state = frame["state"].fillna(0).to_numpy(np.int64)
    steps = frame["steps"].to_numpy(np.int64)
    up = _index(nodes, nxt)
    ends = (up < 0) | (state > 0)
    jump = np.where(ends, np.arange(n), up)
    dist = np.where(ends, 0, steps)
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
        dist = dist + dist[jump]
        jump = jump[jump]
    done = ends[jump]
    on_cycle = np.zeros(n, bool)
    on_cycle[jump[~done]] = True  # n steps or more behind any node that leads into a cycle lies the cycle itself
    last, last_state = jump, state[jump]
    resolved = done & (last_state > 0)
    out_state = np.where(resolved, np.where(last_state == TREE, TREE, np.where(ends, last_state, UNDER)), 0)
    out_state[~done] = np.where(on_cycle[~done], CYCLE, UNDER)
    leaves = done & ~resolved
    root = frame["root"].to_numpy(object)[last]
    return pd.DataFrame(
        {
            "node": nodes,
            "next": nxt,
            "exit": np.where(leaves, nxt[last], None),
            "steps": np.where(leaves, dist + steps[last], np.where(out_state == TREE, dist + steps[last], -1)),
            "state": out_state,
            "root": np.where(out_state == TREE, root, None),
        }
    )


def _whole(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)


def _contract_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = _whole(frames, ["node", "next", "steps", "state", "root", "pid"])
    if len(frame):
        out = _contract(frame)
        out["pid"] = frame["pid"].to_numpy()
        yield out


def _mark_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of fragments whose exit lies on a cycle of the quotient: the nodes on the way from an entry on that cycle."""
    frame = _whole(frames, ["node", "next", "entry"])
    if not len(frame):
        return
    nodes = frame["node"].to_numpy(object)
    up = _index(nodes, frame["next"].to_numpy(object))
    on = np.zeros(len(frame), bool)
    for i in np.flatnonzero(frame["entry"].to_numpy(bool)):
        while i >= 0 and not on[i]:
            on[i] = True
            i = up[i]
    yield pd.DataFrame({"node": nodes, "root": None, "depth": -1, "state": np.where(on, CYCLE, UNDER)})


def _solve(links: DataFrame, rows_per_partition: int, level: int = 0) -> DataFrame:
    """(node, root, depth, state) of every node of links(node, next, steps, state, root)."""
    n = links.count()
    parts = max(1, math.ceil(n / rows_per_partition))
    if parts == 1:
        placed = links.withColumn("pid", F.lit(0)).coalesce(1) if level else links.withColumn("pid", F.lit(0)).repartition(1)
    else:
        heavy = links.groupBy("next").count().where(F.col("count") > max(2, rows_per_partition // 4)).select(F.col("next").alias("hot"))  # at most four a partition
        tail = (F.abs(F.xxhash64(F.lit(level), F.col("node"))) % 2 == 0) & F.col("next").isNotNull() & F.col("hot").isNull()
        home = F.when(tail, F.col("next")).otherwise(F.col("node"))
        placed = links.join(F.broadcast(heavy), links["next"] == heavy["hot"], "left").withColumn("pid", F.pmod(F.xxhash64(home), F.lit(parts)).cast("int")).drop("hot").repartition(parts, "pid")
    local = placed.mapInPandas(_contract_partition, "node string, next string, exit string, steps bigint, state int, root string, pid int")
    local = materialize(local, f"hierarchy-{level}")
    resolved = local.where("exit IS NULL").select("node", "root", F.col("steps").alias("depth"), "state")
    exits = local.where("exit IS NOT NULL")
    entries = exits.select(F.col("exit").alias("entry")).distinct()
    own = local.select("node", F.col("exit").alias("next"), "steps", "state", "root")
    quotient = entries.join(own, entries["entry"] == own["node"], "left").select(
        F.col("entry").alias("node"),
        "next",
        F.coalesce("steps", F.lit(0)).alias("steps"),
        F.when(F.col("node").isNull(), TREE).when(F.col("state") > 0, F.col("state")).cast("int").alias("state"),
        F.when(F.col("node").isNull(), F.col("entry")).otherwise(F.col("root")).alias("root"),
    )
    quotient = materialize(quotient, f"hierarchy-quotient-{level}")
    if parts == 1:  # whatever is outside the only partition is outside the table: a root
        above = quotient.select(F.col("node").alias("exit"), "root", F.col("steps").alias("depth"), "state")
    elif quotient.isEmpty():
        return resolved
    else:
        above = _solve(quotient, rows_per_partition, level + 1).withColumnRenamed("node", "exit")
    joined = join_hot(exits.drop("root", "state"), above, "exit")  # a hot parent may be the exit of most fragments
    direct = joined.where(F.col("state") != CYCLE).select("node", "root", F.when(F.col("state") == TREE, F.col("steps") + F.col("depth")).otherwise(-1).alias("depth"), "state")
    marked = above.where(F.col("state") == CYCLE).select(F.col("exit").alias("entry_node"))
    behind = joined.where(F.col("state") == CYCLE).select("node", "next", "pid").join(marked, F.col("node") == F.col("entry_node"), "left")
    behind = behind.select("node", "next", "pid", F.col("entry_node").isNotNull().alias("entry")).repartition(parts, "pid").drop("pid")
    around = behind.mapInPandas(_mark_partition, "node string, root string, depth bigint, state int")
    return resolved.unionByName(direct).unionByName(around)


def resolve_hierarchy(rows: DataFrame, child: str, parent: str, weight: str | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(firm_id, root_firm_id, depth, node_state) of every child; see the module for the rules."""
    chosen = materialize(choose_parent(rows, child, parent, weight), "hierarchy-links")
    links = chosen.select(
        "node",
        F.col("parent").alias("next"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(F.col("parent").isNull(), TREE).cast("int").alias("state"),
        F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
    )
    solved = _solve(links, rows_per_partition)
    return solved.select(
        F.col("node").alias("firm_id"),
        F.coalesce("root", F.lit("")).alias("root_firm_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("state") == TREE, "tree").when(F.col("state") == CYCLE, "cycle").otherwise("under_cycle").alias("node_state"),
    )


def hierarchy_paths(rows: DataFrame, child: str, parent: str, weight: str | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(firm_id, path) of all nodes in trees: the ids from the root down to the node.

    Pointer doubling over ancestor arrays: after k rounds a node holds its 2**k nearest ancestors, so the number of joins
    is the logarithm of the greatest depth, known from `resolve_hierarchy`.
    """
    chosen = materialize(choose_parent(rows, child, parent, weight), "hierarchy-links")
    links = chosen.select("node", F.col("parent").alias("next"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.when(F.col("parent").isNull(), TREE).cast("int").alias("state"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"))
    state = materialize(_solve(links, rows_per_partition).where(F.col("state") == TREE).select("node", "depth"), "hierarchy-depths")
    deepest = state.agg(F.max("depth")).first()[0] or 0
    paths = chosen.join(state, "node").select("node", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("above"), "depth")
    for k in range(max(0, math.ceil(math.log2(deepest + 1)))):
        paths = materialize(paths, f"hierarchy-paths-{k}")
        lift = paths.select(F.col("node").alias("top"), F.col("above").alias("more"))
        paths = paths.withColumn("top", F.when(F.size("above") > 0, F.element_at("above", -1))).join(lift, "top", "left").select("node", F.when(F.col("more").isNotNull(), F.concat("above", "more")).otherwise(F.col("above")).alias("above"), "depth")
    return paths.select(F.col("node").alias("firm_id"), F.concat(F.reverse("above"), F.array("node")).alias("path"), F.col("depth").cast("bigint").alias("depth"))


def descendants(paths: DataFrame) -> DataFrame:
    """(firm_id, descendant, steps) for every node and everything below it."""
    up = paths.select(F.col("firm_id").alias("descendant"), "depth", F.posexplode("path").alias("at", "firm_id"))
    return up.where(F.col("at") < F.col("depth")).select("firm_id", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("steps"))
