from pyspark.sql import functions as F

from ledgerfold.functions.columns import cosine, jaccard, normal_cdf, similarity, token_sort
from ledgerfold.operators.graph import bfs, components, triangles
from ledgerfold.operators.skew import eager_join_aggregate, heavy_keys, join_hot
from ledgerfold.sources.tables import insert_or_ignore, upsert


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", None), (None, "a", 5.0), ("z", None, 7.0)], "k string, g string, v double")
    right = spark.createDataFrame([("k", 10), ("k", 20), ("z", 1), (None, 3)], "k string, v int")
    out = {r["left_g"]: (r["n_pairs"], r["sum_left"], r["sum_right"]) for r in eager_join_aggregate(left, right, ["k"], ["k"], ["g"], [], "v", "v").collect()}
    assert out == {"a": (4, 6.0, 60), "b": (2, None, 30), None: (1, 7.0, 1)}
    assert eager_join_aggregate(left.limit(0), right, ["k"], ["k"], ["g"], []).count() == 0


def test_heavy_keys(spark):
    rows = spark.createDataFrame([("t", "hot")] * 40 + [("t", None)] * 30 + [("t", f"k{i}") for i in range(30)] + [("u", "one")], "s string, key string")
    assert {(r["s"], r["key"]) for r in heavy_keys(rows, "s", "key", 0.02).collect()} == {("t", "hot"), ("u", "one")}
    assert heavy_keys(rows.limit(0), "s", "key", 0.02).count() == 0


def test_columns(spark):
    r = spark.sql("SELECT array(1.0D, 0.0D) AS a, array(0.0D, 0.0D) AS z, array('x') AS s, cast(array() AS array<string>) AS e").select(cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z")), jaccard(F.col("e"), F.col("e")), jaccard(F.col("s"), F.col("e")), normal_cdf(F.lit(1.96)), similarity(F.lit("abcd"), F.lit("abce")), token_sort(F.lit("The B. Alpha"))).first()
    assert (r[0], r[1], r[2], r[3]) == (1.0, 0.0, 0.0, 0.0) and abs(r[4] - 0.9750021) < 1e-6 and r[5] == 0.75 and r[6] == "alpha b the"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("x", "x")], "src string, dst string")
    assert {(r["node"], r["level"]) for r in bfs(e, spark.createDataFrame([("a",)], "node string"), 2, "out").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"]: r["component"] for r in components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    t = {r["node"]: (r["degree"], r["triangles"]) for r in triangles(e).collect()}
    assert t == {"a": (2, 1), "b": (2, 1), "c": (3, 1), "d": (1, 0), "x": (1, 0), "y": (1, 0)}


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 7), (3, "e", 1)], "k int, v string, t int")
    assert {tuple(r) for r in upsert(old, new, ["k"], "t").collect()} == {(1, "a", 1), (2, "d", 7), (3, "e", 1)}
    assert {r["k"] for r in insert_or_ignore(old, new, ["k"]).collect()} == {3}


def test_long_chain_is_one_component(spark):
    e = spark.range(10_000).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    assert [r["component"] for r in components(e).select("component").distinct().collect()] == ["n00000"]


def test_join_with_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [("a", 1), ("b", 2), (None, 3), ("none", 4)], "k string, v int")
    right = spark.createDataFrame([("hot", "x"), ("a", "y"), ("b", "z"), (None, "n")], "k string, w string")
    for how in ("inner", "left"):
        want = left.join(right, "k", how).groupBy("w").count().collect()
        assert sorted(map(str, join_hot(left, right, "k", how).groupBy("w").count().collect())) == sorted(map(str, want))
    assert join_hot(left.limit(0), right, "k").count() == 0
