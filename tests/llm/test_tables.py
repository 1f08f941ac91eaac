import datetime as dt
import random

import numpy as np

from ledgerfold.llm.cooccur import associations
from ledgerfold.llm.packing import pack, pack_lengths
from ledgerfold.llm.topn import candidates, rank_candidates, top_n

SURFACE = "firm string, cluster string, year int, score double, at timestamp, grp string, rank int"


def test_top_n(spark):
    rng, t = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [("hot", f"c{rng.randrange(300)}", rng.randrange(2010, 2024), rng.choice([0.5, 0.9, rng.random(), None, float("nan"), 1.5]), t + dt.timedelta(days=rng.randrange(90)), "x", 1) for _ in range(3000)]
    rows += [(f"f{i % 40}", f"c{rng.randrange(9)}", 2020, rng.random(), t, None, None) for i in range(200)] + [(None, "c1", 2020, 0.5, t, "x", 1)]
    rows += rows[:50]
    last = {}
    for f, c, y, s, at, *_ in rows:
        if f is not None:
            v = (at, s is not None, s is not None and s != s, s if s is not None and s == s else 0)
            if (f, c, y) not in last or v > last[f, c, y][0]:
                last[f, c, y] = (v, s)
    want = {}
    for (f, c, y), (_, s) in last.items():
        if s is not None and s == s and 0 <= s <= 1:
            want.setdefault(f, []).append((-s, -y, c))
    want = {(f, c, -y) for f, v in want.items() for s, y, c in sorted(v)[:5]}
    got = top_n(spark.createDataFrame(rows, SURFACE), "firm", "cluster", "year", "score", "at", 5, row_group_bytes=4096)
    assert {(r["grp"], r["item"], r["year"]) for r in got.collect()} == want
    assert top_n(spark.createDataFrame([], SURFACE), "firm", "cluster", "year", "score", "at", 5).count() == 0


def test_top_n_skips(spark):
    """Most row groups of large groups lie below their N-th score and are not read."""
    rng, t = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(f"f{i % 60}", f"c{i}", 2020, rng.random(), t, None, None) for i in range(24_000)]
    found = candidates(spark.createDataFrame(rows, SURFACE), "firm", "cluster", "year", "score", "at", 5, row_group_bytes=4096)
    read, skipped = found.selectExpr("sum(row_groups)", "sum(skipped)").first()
    assert skipped > 4 * read
    want = {(f, c) for f in {r[0] for r in rows} for _, c in sorted((-r[3], r[1]) for r in rows if r[0] == f)[:5]}
    assert {(r["grp"], r["item"]) for r in rank_candidates(found, 5).collect()} == want


def test_one_basket_of_thousands(spark):
    """Every pair of one basket of 3,000 items comes once, through pairs of chunks."""
    rows = [("hot", f"i{i:04d}", "x") for i in range(3000)] + [("b", "i0001", "x"), ("b", "i0002", "x")]
    got = associations(spark.createDataFrame(rows, "basket string, item string, chunk string"), "basket", "item")
    n, two, most = got.selectExpr("count(*)", "sum(CASE WHEN together = 2 THEN 1 ELSE 0 END)", "max(together)").first()
    assert (n, two, most) == (3000 * 2999 // 2, 1, 2)


def test_cooccurrence(spark):
    rng = random.Random(4)
    rows = [(f"b{rng.randrange(30)}", f"i {rng.randrange(12)}", "x") for _ in range(200)] + [("big", f"i{i}", "x") for i in range(90)] + [(None, "i1", "x"), ("b1", None, "x"), ("b1", " ", "x")]
    sets = {}
    for b, i, _ in rows:
        if b and i and i.strip():
            sets.setdefault(b, set()).add(i.replace(" ", "").upper())
    want = {}
    for s in sets.values():
        for x in s:
            for y in s:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    df = spark.createDataFrame(rows, "basket string, item string, chunk string")
    for chunk in (7, 64):
        got = {(r["a"], r["b"]): (r["together"], r["n"]) for r in associations(df, "basket", "item", chunk).collect()}
        assert got == {k: (v, len(sets)) for k, v in want.items()}
    assert associations(df.limit(0), "basket", "item").count() == 0


def test_best_two_fit():
    bins = pack_lengths(np.array([7, 2, 3, 3, 5]), 13)
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(1, 100, 500)
        bins = pack_lengths(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(500)) and max(lengths[b].sum() for b in bins) <= 100
        fill: list[int] = []  # never worse than first fit decreasing
        for x in sorted(lengths, reverse=True):
            at = next((i for i, b in enumerate(fill) if b + x <= 100), None)
            if at is None:
                fill.append(x)
            else:
                fill[at] += x
        assert len(bins) <= len(fill)


def test_pack(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 60, 99, 100, 101, 350, rng.randrange(1, 120)])) for i in range(400)]
    out = pack(spark.createDataFrame(items, "item bigint, tokens bigint"), 100, items_per_task=50).collect()
    total, bins = {}, {}
    for r in out:
        total[r["item"]] = total.get(r["item"], 0) + r["tokens"]
        bins[r["container"]] = bins.get(r["container"], 0) + r["tokens"]
    assert total == {i: n for i, n in items if n} and max(bins.values()) <= 100
    assert all(sum(r["item"] == i for r in out) == -(-n // 100) for i, n in items)
    assert pack(spark.createDataFrame([], "item bigint, tokens bigint"), 100).count() == 0
