"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Method: both inputs are aggregated by the join key before the join (with combiners on the map side, so a hot key leaves
every task as one row), the compact states are joined, counts are multiplied and sums combined by algebra, and the result
is rolled up to the wanted keys. No row of a hot key meets another one.

Defined results: null join keys match nothing; null group keys are a group of their own unless dropped by the caller; null
measures add nothing; repeated rows count as often as they occur; empty inputs give empty results; other columns, also of
the same name on both sides, are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SCOPES = 10_000


def _state(df: DataFrame, on: list[str], keys: list[str], value: str | None, side: str) -> DataFrame:
    cols = [*dict.fromkeys([*on, *keys])]
    aggs = [F.count(F.lit(1)).alias(f"n_{side}")]
    if value:
        aggs.append(F.sum(value).alias(f"s_{side}"))
    out = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in on))).groupBy(*cols).agg(*aggs)
    return out.select(*[F.col(c).alias(f"on_{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"{side}_{c}") for c in keys], *[c for c in out.columns if c in (f"n_{side}", f"s_{side}")])


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], left_keys: list[str], right_keys: list[str], left_sum: str | None = None, right_sum: str | None = None, few_right: int = 0) -> DataFrame:
    """What `left JOIN right ... GROUP BY keys` gives for count(*) and sums, without joining rows.

    Columns: `left_<key>`, `right_<key>`, `n_pairs` (count of joined rows), `n_left_rows` and `n_right_rows` (rows of each
    side under the group's join keys), and `sum_left`, `sum_right` (sums over the joined rows) where measures are named. With
    *few_right* the states of the right side are fetched, and broadcast if there are no more than that.
    """
    a, b = _state(left, left_on, left_keys, left_sum, "left"), _state(right, right_on, right_keys, right_sum, "right")
    if few_right:
        states = b.limit(few_right + 1).collect()
        if len(states) <= few_right:
            b = F.broadcast(left.sparkSession.createDataFrame(states, b.schema))
    joined = a.join(b, [f"on_{i}" for i in range(len(left_on))])
    aggs = [F.sum(F.col("n_left") * F.col("n_right")).alias("n_pairs"), F.sum("n_left").alias("n_left_rows"), F.sum("n_right").alias("n_right_rows")]
    if left_sum:
        aggs.append(F.sum(F.col("s_left") * F.col("n_right")).alias("sum_left"))
    if right_sum:
        aggs.append(F.sum(F.col("s_right") * F.col("n_left")).alias("sum_right"))
    return joined.groupBy(*[f"left_{c}" for c in left_keys], *[f"right_{c}" for c in right_keys]).agg(*aggs)


def heavy_keys(rows: DataFrame, scope: str, key: str, share: float) -> DataFrame:
    """(scope, key, n, n_scope) of non-null keys that hold at least *share* of all rows of their scope.

    That is the join of the rows with the rows of their scope, counted by key: both sides are aggregated first, the states by
    key meet the state of their scope. Scopes are names of tables or the like; their states are counted before they are
    broadcast.
    """
    known = rows.where(F.col(scope).isNotNull())
    pairs = eager_join_aggregate(known, known, [scope], [scope], [scope, key], [], few_right=MOST_SCOPES)
    heavy = pairs.where(F.col(f"left_{key}").isNotNull() & (F.col("n_left_rows") >= F.lit(share) * F.col("n_right_rows")))
    return heavy.select(F.col(f"left_{scope}").alias(scope), F.col(f"left_{key}").alias(key), F.col("n_left_rows").alias("n"), F.col("n_right_rows").alias("n_scope"))


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left JOIN right on a key that is unique in *right*, where a few keys may hold most rows of *left*.

    Keys of more than a quarter of a task's share are at most four a task; their rows of *right* are broadcast, so that the rows
    of *left* stay where they are. Null keys match nothing and are not exchanged. *how* is inner or left.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = left.where(F.col(on).isNotNull())
    fair = max(1_000, known.count() // (4 * tasks))
    hot = known.groupBy(on).count().where(F.col("count") > fair).select(on)  # at most 4 * tasks rows
    some = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    out = known.join(F.broadcast(hot), on, "left_semi").join(some, on, how).unionByName(known.join(F.broadcast(hot), on, "left_anti").join(right, on, how))
    if how != "left":
        return out
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != on]
    return out.unionByName(left.where(F.col(on).isNull()).select("*", *empty))
