import random

from ledgerfold.operators.hierarchy import descendants, hierarchy_paths, resolve_hierarchy

SCHEMA = "firm_id string, parent_firm_id string, ownership_pct double, node string"


def brute(rows):
    best = {}
    nodes = set()
    for child, parent, pct, *_ in rows:
        c = (child or "").strip().lower()
        p = (parent or "").strip().lower()
        if not c:
            continue
        nodes.add(c)
        if p and p != c:
            key = (float("inf") if pct is None else -pct, p)
            best[c] = min(best.get(c, key), key)
    up = {c: k[1] for c, k in best.items()}
    out = {}
    for c in nodes:
        seen, at = [], c
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            out[c] = ("", -1, "cycle" if c in seen[seen.index(at) :] else "under_cycle")
        else:
            out[c] = (at, len(seen), "tree")
    return out


def got(df):
    return {r["firm_id"]: (r["root_firm_id"], r["depth"], r["node_state"]) for r in df.collect()}


def test_cases(spark):
    rows = [(" A ", "b", 10.0, "x"), ("a", "c", 60.0, "x"), ("B", None, None, None), ("c", "c", 5.0, "x"), ("d", "e", None, "x"), ("e", "d", None, "x"), ("f", "d", None, "x"), (None, "a", 1.0, "x"), ("", "a", 1.0, "x"), ("g", "outside", None, "x"), ("g", "outside", None, "x")]
    assert got(resolve_hierarchy(spark.createDataFrame(rows, SCHEMA), "firm_id", "parent_firm_id", "ownership_pct")) == brute(rows)


def test_empty(spark):
    assert got(resolve_hierarchy(spark.createDataFrame([], SCHEMA), "firm_id", "parent_firm_id", "ownership_pct")) == {}


def test_random_over_partitions(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", f"n{rng.randrange(max(1, i - 12), i + 2)}", rng.choice([None, 5.0, 50.0]), None) for i in range(1, 400)]
    rows += [(f"c{i}", f"c{(i + 1) % 60}", None, None) for i in range(60)] + [(f"u{i}", f"c{i}", None, None) for i in range(9)]
    rows += [(f"h{i}", "n1", None, None) for i in range(150)]  # a hot parent
    assert got(resolve_hierarchy(spark.createDataFrame(rows, SCHEMA), "firm_id", "parent_firm_id", "ownership_pct", 40)) == brute(rows)


def test_paths(spark):
    rows = [("b", "a", None, None), ("c", "b", None, None), ("d", "c", None, None), ("x", "y", None, None), ("y", "x", None, None)]
    paths = hierarchy_paths(spark.createDataFrame(rows, SCHEMA), "firm_id", "parent_firm_id", "ownership_pct")
    assert {r["firm_id"]: r["path"] for r in paths.collect()} == {"b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "c", "d"]}
    assert {(r["firm_id"], r["descendant"], r["steps"]) for r in descendants(paths).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}
