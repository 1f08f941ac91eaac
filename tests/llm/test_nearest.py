import numpy as np

from ledgerfold.llm.knn import nearest


def test_nearest(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base * 3 + 0.05 * rng.normal(size=(60, 8)), np.repeat(base[:1], 40, axis=0) * 2])
    rows = [(f"k{i:03d}", "g" if i < 2 else f"g{i}", v.tolist(), 1) for i, v in enumerate(x)] + [("bad1", "a", [0.0] * 8, 1), ("bad2", "a", None, 1), ("bad3", "a", [float("nan")] * 8, 1), ("bad4", "a", [1.0], 1), (None, "a", [1.0] * 8, 1)]
    df = spark.createDataFrame(rows + rows[:20], "k string, g string, v array<double>, leaf int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(len(x)):
        others = [j for j in range(len(x)) if rows[j][1] != rows[i][1] and s[i, j] >= 0.9]
        want |= {(rows[i][0], rows[j][0]) for j in sorted(others, key=lambda j: (-s[i, j], rows[j][0]))[:3]}
    got = {(r["key"], r["neighbour"]) for r in nearest(df, "k", "g", "v", 3, 0.9, dim=8, leaf=20).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert nearest(df.limit(0), "k", "g", "v", 3, dim=8).count() == 0


def test_copies_in_one_group(spark):
    """Many copies of one direction in one group: each still finds the neighbours of another group."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=8)
    rows = [(f"a{i:03d}", "one", (v * (i + 1)).tolist(), 1) for i in range(60)] + [(f"b{i}", f"g{i}", (v + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(3)] + [(f"c{i}", f"h{i}", rng.normal(size=8).tolist(), 1) for i in range(40)]
    got = {(r["key"], r["neighbour"]) for r in nearest(spark.createDataFrame(rows, "k string, g string, v array<double>, leaf int"), "k", "g", "v", 3, 0.95, dim=8, leaf=20).collect()}
    assert {(f"a{i:03d}", f"b{j}") for i in range(60) for j in range(3)} <= got


def test_repeated_rows_take_no_rank(spark):
    """A row repeated in the table, as query or as neighbour, leaves its ranks to other neighbours."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=8) + 0.1 * rng.normal(size=(12, 8))
    rows = [(f"k{i:02d}", f"g{i}", v.tolist(), 1) for i, v in enumerate(x)]
    found = nearest(spark.createDataFrame(rows * 3, "k string, g string, v array<double>, leaf int").repartition(7), "k", "g", "v", 3, dim=8, leaf=5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(f"k{i:02d}", f"k{j:02d}") for i in range(12) for j in sorted((j for j in range(12) if j != i), key=lambda j: (-s[i, j], j))[:3]}
    assert len(found) == 36 and {(r["key"], r["neighbour"]) for r in found} == want
