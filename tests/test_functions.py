"""The function API, linking, vectors, text, loads and watches on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.api import Engine, page, page_count
from ledgerfold.operators.graph import bfs_edges, label_propagation, path_lengths, percolation
from ledgerfold.operators.linking import company_key, link_names
from ledgerfold.operators.similar import centroids, decayed_means, kmeans_in_groups, nearest_centroids, set_similarity, velocities
from ledgerfold.operators.simulate import npv_paths, portfolio_var
from ledgerfold.operators.text_search import bm25, matches, sanitise, search_variants, variants
from ledgerfold.session import scratch_path
from ledgerfold.sources import tables as sinks
from ledgerfold.streaming.watch import ALERTS, acknowledge, delete_watch, poll
from tests.conftest import DATA


def test_pages(spark):
    df = spark.range(45)
    first = lambda n, size: [r["id"] for r in page(df, [F.col("id")], n, size).collect()]
    assert first(1, 20) == list(range(20)) and first(3, 20) == list(range(40, 45)) and first(0, 10) == list(range(10)) and first(9, 20) == []
    assert len(first(1, 1000)) == 45 and len(first(1, -5)) == 1 and len(first(1, 0)) == 20
    assert (page_count(0), page_count(45), page_count(45, 1000)) == (1, 3, 1)


def test_search(spark):
    assert sanitise("AND a (OR)") is None and sanitise("gear NOT box*") == ["gear", "box"]
    assert [how for how, _ in variants("the turbine gear")] == ["all", "any", "one"] and variants("") == []
    docs = spark.createDataFrame([(1, "Turbine gear"), (2, "a turbine"), (3, None)], "id int, t string")
    assert {(r["id"], r["how"]) for r in search_variants(docs, "id", F.col("t"), "turbine gear").collect()} == {(1, "all")}
    assert {(r["id"], r["how"]) for r in search_variants(docs, "id", F.col("t"), "turbine valve").collect()} == {(1, "any"), (2, "any")}
    assert search_variants(docs, "id", F.col("t"), "or").count() == 0 and docs.where(matches(F.col("t"), "all", [])).count() == 0
    scores = {r["doc_id"]: r["score"] for r in bm25(docs, "id", "t", ["gear", "turbine"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    e = Engine(spark, DATA)
    assert e.patent_search(query="zzzz qqqq").count() == 0 and e.patent_search(size=7).count() == 7
    every, us = e.patent_search(size=100), e.patent_search(jurisdiction="us", size=100)
    assert all(r["id"].startswith("US-") for r in us.collect()) and every.count() >= us.count() > 0
    one = every.first()["id"]
    assert e.patent_detail(one).count() == 1 and e.patent_detail("nothing").count() == 0
    assert any(n == "patent_search" for n, _ in Engine.help("query"))


def test_linking(spark):
    key = lambda t: spark.range(1).select(company_key(F.lit(t))).first()[0]
    assert key("The ＡＢＣ & Sons, Co., Ltd.") == "abc and sons" and key("株式会社ソニック") == "ソニック"
    register = spark.createDataFrame([("f1", "Badigumone Foods"), ("f2", "Terasomogu Glass"), (None, "x"), ("f3", None)], "e string, n string")
    names = spark.createDataFrame([("Badigumone Foods",), ("BADIGUMONE FOODS, INC.",), ("Foods Badigumonne",), ("MVG",), ("zzz",), (None,), (" ",)], "name string")
    got = {r["name"]: (r["entity"], r["level"]) for r in link_names(names, "name", register, "e", "n", {"MVG": "f2"}).collect()}
    assert got == {"Badigumone Foods": ("f1", "exact"), "BADIGUMONE FOODS, INC.": ("f1", "normalised"), "Foods Badigumonne": ("f1", "fuzzy"), "MVG": ("f2", "override"), "zzz": (None, "none")}
    assert {r["level"] for r in link_names(names, "name", register.limit(0), "e", "n").collect()} == {"none"}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, f"g{i % 3}", v.tolist(), 2000 + i % 4) for i, v in enumerate(x)] + [(99, "g0", [0.0] * 4, 2000)], "id int, g string, v array<double>, y int")
    c = centroids(df.where("id < 50"), "g", "v")
    centre = {r["g"]: np.array(r["centre"]) for r in c.collect()}
    for g in centre:
        assert np.allclose(centre[g], x[[i for i in range(50) if f"g{i % 3}" == g]].mean(0))
    got = {(r["id"], r["rank"]): (r["g"], r["similarity"]) for r in nearest_centroids(df, "id", "v", c, "g", 2).collect()}
    for i, v in enumerate(x):
        sims = sorted(((-round(float(v @ centre[g] / np.linalg.norm(v) / np.linalg.norm(centre[g])), 6), g) for g in centre))
        assert got[i, 1] == (sims[0][1], -sims[0][0]) and got[i, 2][0] == sims[1][1]
    assert got[99, 1] == ("g0", 0.0)
    k = kmeans_in_groups(spark.createDataFrame([("a", str(i), [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(20)] + [("b", "x", [1.0, 1.0])], "g string, key string, v array<double>"), "g", "key", "v", 3, 4)
    rows = k.collect()
    assert len({(r["cluster"]) for r in rows if r["g"] == "a" and int(r["key"]) % 2}) == 1 and next(r["k"] for r in rows if r["g"] == "a") == 2 and next(r["k"] for r in rows if r["g"] == "b") == 1
    f = spark.createDataFrame([("f", 2000, [1.0, 0.0], 4), ("f", 2001, [0.0, 1.0], 1), ("f", 2003, [0.0, 0.0], None)], "f string, y int, v array<double>, n int")
    means = {r["year"]: r["vec"] for r in decayed_means(f, "f", "y", "v", "n").collect()}
    assert np.allclose(means[2001], np.array([2 * np.exp(-0.1), 1.0]) / (2 * np.exp(-0.1) + 1))
    speed = {r["y"]: r["velocity"] for r in velocities(f, "f", "y", "v").collect()}
    assert speed[2000] is None and abs(speed[2001] - 2**0.5) < 1e-12 and speed[2003] is None
    s = set_similarity(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2), ("b", 3)], "o string, i int"), "o", "i", "a").collect()
    assert [(r["o"], r["shared"], r["jaccard"]) for r in s] == [("b", 1, 0.333333)]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["hops"]) for r in path_lengths(e, start, 20).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r["src"], r["dst"], r["level"]) for r in bfs_edges(e, start, 2).collect()} == {("a", "b", 1), ("b", "c", 2)}
    assert {r["node"]: r["label"] for r in label_propagation(e, 1).collect()} == {"a": "b", "b": "a", "c": "b", "d": "c", "x": "y", "y": "x"}
    assert [(r["removed"], r["largest"]) for r in percolation(e, [0.0, 0.2]).orderBy("share").collect()] == [(0, 4), (1, 2)]


def test_simulations(spark):
    x = spark.createDataFrame([("f", 1.0, 1.0, 1.0, 1.0, 1.0), ("g", 0.5, 0.5, 0.5, 0.5, 0.5)], "firm string, a double, b double, c double, d double, e double")
    r = {r["firm"]: r for r in portfolio_var(x, "firm", list("abcde")).collect()}
    rng = np.random.default_rng(42)
    loss = sum(rng.beta(a, b, 1000) for a, b in ((2, 8), (2, 10), (1, 20), (2, 15), (2, 10)))
    assert abs(r["f"]["var95"] - np.percentile(loss, 95)) < 1e-5 and abs(r["g"]["var95"] * 2 - r["f"]["var95"]) < 1e-5 and r["f"]["cvar95"] >= r["f"]["var95"]
    n = npv_paths(spark.createDataFrame([("f", 100.0, 0.05, 0.01)], "f string, i double, g double, s double"), "f", "i", "g", "s").first()
    assert 0 < n["npv_low"] < n["npv_mean"] and n["npv_low"] < n["npv_high"]


def test_loads_and_sinks(spark):
    root = scratch_path(spark, "test-loads")
    log = spark.createDataFrame([], "source string, mark bigint, rows bigint")
    for lo, hi in ((0, 10), (10, 15), (15, 15)):
        spark.range(lo, hi).write.mode("append").parquet(f"{root}/in")
        log = log.unionByName(sinks.load_new(sinks.ParquetSource(f"{root}/in", "id"), spark, log, "s", f"{root}/out", "id"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == list(range(15)) and log.count() == 2
    lists = spark.createDataFrame([('["a","b"]',), ("a; b|c",), ("[broken",), (None,), ("",)], "t string").select(F.size(sinks.text_list(F.col("t")))).collect()
    assert [r[0] for r in lists] == [2, 3, 0, 0, 0]
    spark.createDataFrame([("1", "x")], "`Decl ID` string, Org string").write.option("header", True).csv(f"{root}/csv")
    assert tuple(sinks.read_csv(spark, f"{root}/csv", {"id": ["id", "decl id"], "org": ["ORG"], "no": ["none"]}).first()) == ("1", "x", None)
    p, c = sinks.upsert_with_children(spark.createDataFrame([(1, 0), (2, 0)], "k int, t int"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(1, 5), (None, 5)], "k int, t int"), spark.createDataFrame([(1, "z"), (3, "q")], "k int, v string"), "k", "t")
    assert {tuple(r) for r in p.collect()} == {(1, 5), (2, 0)} and {tuple(r) for r in c.collect()} == {(1, "z"), (2, "c")}


def test_watches(spark):
    rows = spark.createDataFrame([("p1", 1, "Acme Foods", "F31H", "a sensor", "f1"), ("p2", 2, "Other", None, None, None), ("p3", 9, "ACME", "F31K", "x", "f9")], "id string, at bigint, name string, code string, title string, firm string")
    w = spark.createDataFrame([("a", "applicant", "acme", 1, None), ("c", "class", "F31", 1, None), ("k", "keyword", "SENSOR", 1, None), ("o", "competitor", "f9", 1, None), ("n", "class", "Z", 1, None)], "watch string, kind string, value string, least int, last_checked bigint")
    alerts = spark.createDataFrame([], ALERTS)
    for until in (5, 10, 10):
        w, alerts = poll(rows, w, alerts, until, "name", "code", "title", "firm")
    got = sorted((r["watch"], r["until"], r["n"]) for r in alerts.collect())
    assert got == [("a", 5, 1), ("a", 10, 1), ("c", 5, 1), ("c", 10, 1), ("k", 5, 1), ("o", 10, 1)] and {r["last_checked"] for r in w.collect()} == {10}
    one = alerts.first()["alert"]
    assert acknowledge(alerts, [one]).where("acknowledged").count() == 1
    left, rest = delete_watch(w, alerts, "a")
    assert left.count() == 4 and rest.where("watch = 'a'").count() == 0
