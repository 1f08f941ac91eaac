"""Most similar vectors for every vector: a hierarchical k-means tree searched best bin first.

Method: a k-means tree is fitted on a bounded sample (`sample` vectors by hash of the key; by default eight a leaf, at least
20,000 and at most 200,000, so that leaves keep their size up to ten million vectors). Every vector
goes to its leaf; the index is a table in the shared folder, sorted by leaf, leaves numbered along the tree, with row-group
statistics. A query pops tree nodes from a priority queue by cosine to their centres and visits leaves in that order. How
many leaves are visited is calibrated: for `calibration` sample vectors the true neighbours (by a scan of all rows) are
looked up in the order of visits, and visits are widened until the wanted recall is reached; if `min_cosine` is set, on
neighbours at least that close. Candidates are found in single and ranked in double precision.

Copies: of vectors of one direction only the few smallest keys that can be anyone's neighbour are indexed, chosen before
the shuffle; the other copies are light rows that take their neighbours from those, and those of a copy of their own group.

Cosines are rounded to 9 decimals, ties go to the smaller key. Defined results: vectors null, of other length, with NaN or
infinite numbers, or all zero don't count; null keys don't count; a repeated row counts once; rows of one group are no
neighbours; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.topn import list_files, open_file
from ledgerfold.session import materialize, scratch_path

SAMPLE, MAX_SAMPLE, CALIBRATION, LEAF, BRANCH = 20_000, 200_000, 1024, 384, 24
ROW_GROUP, MOST_GROUPS = 1 << 20, 200_000  # row groups grow where there would be more of them
LEAST_VISITS = 6  # few leaves cost little and make small indexes exact


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)  # else very large or small numbers overflow when squared
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        empty = ~np.isin(np.arange(k), at)
        sums[empty] = centres[empty]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).argmax(1)


class Tree:
    """Nodes in depth-first order: centres, children as ranges of `kids`, the leaf number of leaves (-1 for others)."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 7) -> None:
        self.centres: list[np.ndarray] = []
        self.kids: list[list[int]] = []
        self.leaf: list[int] = []
        self.weight: list[int] = []
        self._rng, self._least = np.random.default_rng(seed), max(1, len(x) // max(1, leaves))
        self._grow(x.astype(np.float32), x.mean(0) if len(x) else np.zeros(1), branch)
        self.centres_ = np.asarray(self.centres, np.float32)
        self.leaf_ = np.asarray(self.leaf)
        del self._rng

    def _grow(self, x: np.ndarray, centre: np.ndarray, branch: int) -> int:
        me = len(self.leaf)
        self.centres.append(centre)
        self.kids.append([])
        self.leaf.append(-1)
        parts = min(branch, len(x) // max(1, self._least))
        if parts >= 2:
            centres, at = _kmeans(x, parts, self._rng)
            order = [i for i in range(parts) if (at == i).any()]
            if len(order) >= 2:
                for i in order:
                    self.kids[me].append(self._grow(x[at == i], centres[i], branch))
                return me
        self.leaf[me] = len(self.weight)
        self.weight.append(len(x))
        return me

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n leaves of every row of x, best bin first (-1 where there are no more)."""
        n = min(n, len(self.weight))
        scores = x.astype(np.float32) @ self.centres_.T
        queue = np.full(scores.shape, -np.inf, np.float32)
        queue[:, 0] = 0
        out, found = np.full((len(x), n), -1, np.int32), np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            top = queue[rows].argmax(1) if len(rows) < len(x) else queue.argmax(1)
            queue[rows, top] = -np.inf
            for node in np.unique(top):
                r = rows[top == node]
                if self.leaf[node] >= 0:
                    out[r, found[r]] = self.leaf[node]
                    found[r] += 1
                else:
                    kids = self.kids[node]
                    queue[np.ix_(r, kids)] = scores[np.ix_(r, kids)]
            rows = np.flatnonzero(found < n)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _keep(keys: list[str], groups: list[str], k: int) -> set[int]:
    """Positions of copies that can be among the k smallest keys outside one's own group."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    first = order[: k + 1]
    kept = set(first)
    for g in {groups[i] for i in first}:
        n = 0
        for i in order:
            if groups[i] != g:
                kept.add(i)
                n += 1
                if n == k:
                    break
    return kept


def valid_vectors(rows: DataFrame, key: str, group: str, vector: str, dim: int) -> DataFrame:
    """(key, grp, vec) of the rows whose vector counts."""
    v = F.col("vec")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    r = rows.select(F.expr(key).cast("string").alias("key"), F.expr(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("vec"))
    return r.where(F.col("key").isNotNull() & v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda e: e != 0))


def _direction(x: np.ndarray) -> np.ndarray:
    """A hash of unit vectors rounded to 10 decimals: equal for copies and scaled copies."""
    bits = np.ascontiguousarray(np.round(x, 10) + 0.0).view(np.uint64)
    mix = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        mix = (mix ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return mix.view(np.int64)


_PLACED = "part int, leaf int, light boolean, key string, grp string, direction bigint, vec array<double>"


def _assign(tree: Tree, parts: np.ndarray, dim: int, k: int):
    names = ["part", "leaf", "light", "key", "grp", "direction", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, groups, vec = b.column(0), b.column(1), b.column(2)
            x = _unit(_matrix(vec, dim))
            leaf, direction = tree.visits(x, 1)[:, 0], _direction(x)
            light = np.zeros(len(x), bool)
            order = np.argsort(direction, kind="stable")
            starts = np.flatnonzero(np.r_[True, direction[order][1:] != direction[order][:-1]])
            sizes = np.diff(np.r_[starts, len(order)])
            for s, size in zip(starts[sizes > k + 1], sizes[sizes > k + 1]):
                at = order[s : s + size]
                kept = _keep(keys.take(pa.array(at)).to_pylist(), groups.take(pa.array(at)).to_pylist(), k)
                light[[at[i] for i in range(size) if i not in kept]] = True
            if light.any():
                vec = pc.if_else(pa.array(light), pa.scalar(None, vec.type), vec)
            columns = [pa.array(parts[leaf].astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(light), keys, groups, pa.array(direction), vec]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class _Index:
    """Row groups of the index, read when needed and held up to a bound of rows."""

    def __init__(self, groups: list[tuple[str, int, int, int]], dim: int, held: int = 60_000) -> None:
        self.groups, self.dim, self.held = groups, dim, held
        self.low, self.high = np.array([g[2] for g in groups]), np.array([g[3] for g in groups])
        self.cache: OrderedDict[int, tuple] = OrderedDict()
        self.files: OrderedDict[str, object] = OrderedDict()

    def read(self, i: int) -> tuple:
        """leaf, key, grp, vectors in double and in single precision of the rows that aren't light."""
        if i in self.cache:
            self.cache.move_to_end(i)
            return self.cache[i]
        path, rg = self.groups[i][:2]
        if path not in self.files:
            self.files[path] = open_file(path)
            if len(self.files) > 32:
                self.files.popitem(last=False)
        t = self.files[path].read_row_group(rg, columns=["leaf", "light", "key", "grp", "vec"])
        t = t.filter(pc.invert(t["light"])).combine_chunks()
        x = _unit(_matrix(t["vec"].chunk(0), self.dim)) if t.num_rows else np.empty((0, self.dim))
        leaf, key, grp = (t[c].to_numpy() for c in ("leaf", "key", "grp"))
        if len(key) > 1:  # repeated rows lie side by side; they would fill the places of the k best of a block
            keep = np.r_[True, (key[1:] != key[:-1]) | (leaf[1:] != leaf[:-1]) | (x[1:] != x[:-1]).any(1)]
            leaf, key, grp, x = leaf[keep], key[keep], grp[keep], x[keep]
        self.cache[i] = (leaf, key, grp, x, x.astype(np.float32))
        while len(self.cache) > 1 and sum(len(c[0]) for c in self.cache.values()) > self.held:
            self.cache.popitem(last=False)
        return self.cache[i]

    def of_leaf(self, leaf: int) -> np.ndarray:
        return np.flatnonzero((self.low <= leaf) & (leaf <= self.high))


class _Best:
    """The k best neighbours of n queries, ranked in double precision, ties by key. Hits are gathered and cut now and then."""

    GATHER = 400_000

    def __init__(self, x: np.ndarray, keys: np.ndarray, groups: np.ndarray, k: int, floor: float) -> None:
        self.x, self.x32, self.keys, self.groups, self.k, self.floor = x, x.astype(np.float32), keys, groups, k, floor
        self.worst = np.full(len(x), floor - 1e-5, np.float32)
        self.hits: list[tuple] = []
        self.n_hits = 0

    def offer(self, ask: np.ndarray, keys: np.ndarray, groups: np.ndarray, b: np.ndarray, b32: np.ndarray, leaves: np.ndarray) -> None:
        for r in range(0, len(b), 8192):
            for s in range(0, len(ask), 512):
                self._block(ask[s : s + 512], keys[r : r + 8192], groups[r : r + 8192], b[r : r + 8192], b32[r : r + 8192], leaves[r : r + 8192])
        if self.n_hits > self.GATHER:
            self.cut()

    def _block(self, ask, keys, groups, b, b32, leaves) -> None:
        sims = self.x32[ask] @ b32.T
        limit = self.worst[ask]
        if self.floor < 0.5:  # nearly all pairs pass the floor: the k-th best of the block is a closer bound
            sims[self.groups[ask][:, None] == groups[None, :]] = -2
            if sims.shape[1] > self.k:
                limit = np.maximum(limit, np.partition(sims, -self.k, axis=1)[:, -self.k])
        qi, bi = np.nonzero(sims >= limit[:, None] - np.float32(4e-6))
        if not len(qi):
            return
        q = ask[qi]
        other = self.groups[q] != groups[bi]
        q, bi = q[other], bi[other]
        cosine = np.round(np.einsum("ij,ij->i", self.x[q], b[bi]), 9)
        close = cosine >= self.floor
        self.hits.append((q[close], cosine[close], keys[bi[close]], leaves[bi[close]]))
        self.n_hits += int(close.sum())

    def cut(self) -> pd.DataFrame:
        if not self.hits:
            return pd.DataFrame({"q": np.empty(0, np.int64), "c": np.empty(0), "key": np.empty(0, object), "leaf": np.empty(0, np.int64)})
        q, c, key, leaf = (np.concatenate(a) for a in zip(*self.hits))
        every = pd.DataFrame({"q": q, "c": c, "key": key, "leaf": leaf}).sort_values(["q", "c", "key"], ascending=[True, False, True], kind="stable").drop_duplicates(["q", "key"])
        rank = every.groupby("q").cumcount()
        full, every = every[rank == self.k - 1], every[rank < self.k]
        self.worst[full["q"].to_numpy()] = np.maximum(self.worst[full["q"].to_numpy()], full["c"].to_numpy(np.float32))
        self.hits, self.n_hits = [tuple(every[n].to_numpy() for n in ("q", "c", "key", "leaf"))], 0
        return every

    def result(self) -> pd.DataFrame:
        h = self.cut()
        q = h["q"].to_numpy()
        return pd.DataFrame({"key": self.keys[q], "grp": self.groups[q], "neighbour": h["key"].to_numpy(), "cosine": h["c"].to_numpy(), "leaf": h["leaf"].to_numpy().astype(np.int64)})


_FOUND = "key string, grp string, neighbour string, cosine double, leaf bigint"


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Row groups of files with their least and greatest leaf."""
    for f in frames:
        for name in f["name"]:
            meta = open_file(name).metadata
            at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            stats = [{c: meta.row_group(i).column(at[c]).statistics for c in ("leaf", "light")} for i in range(meta.num_row_groups)]
            yield pd.DataFrame([(name, i, s["leaf"].min, s["leaf"].max, bool(s["light"].max)) for i, s in enumerate(stats)], columns=["name", "i", "low", "high", "light"])


def _search(tree: Tree, groups: list, dim: int, k: int, visits: int, floor: float, every: int):
    """The neighbours of the rows of some row groups, found by the tree; of keys that hash to 0 modulo *every*.

    A unit is a file's row groups: its queries lie in neighbouring leaves, and every row group they need is read once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(groups, dim)
        for f in frames:
            for first, last in zip(f["first"], f["last"]):
                keys, grps, x = (np.concatenate(a) for a in zip(*(index.read(i)[1:4] for i in range(int(first), int(last)))))
                if every > 1 and len(keys):
                    mine = pd.util.hash_array(keys) % np.uint64(every) == 0
                    keys, grps, x = keys[mine], grps[mine], x[mine]
                if not len(keys):
                    continue
                best, probes = _Best(x, keys, grps, k, floor), tree.visits(x, visits)
                for turns in (slice(0, 1), slice(1, None)):  # the nearest leaves first: the others meet closer bounds
                    leaf = probes[:, turns].ravel()
                    asks = np.repeat(np.arange(len(x)), probes[:, turns].shape[1])[np.argsort(leaf, kind="stable")]
                    leaf = np.sort(leaf, kind="stable")
                    wanted = np.unique(leaf[leaf >= 0])
                    for g in np.flatnonzero(np.searchsorted(wanted, index.low) < np.searchsorted(wanted, index.high, side="right")):
                        leaves, k2, g2, b, b32 = index.read(int(g))
                        for at_leaf in wanted[np.searchsorted(wanted, index.low[g]) : np.searchsorted(wanted, index.high[g], side="right")]:
                            ask = asks[slice(*np.searchsorted(leaf, [at_leaf, at_leaf + 1]))]
                            at = slice(*np.searchsorted(leaves, [at_leaf, at_leaf + 1]))
                            best.offer(ask, k2[at], g2[at], b[at], b32[at], leaves[at])
                    best.cut()
                yield best.result()

    return run


def _scan(groups: list, dim: int, k: int, floor: float, x: np.ndarray, keys: np.ndarray, grps: np.ndarray):
    """Brute force: a bounded set of queries against the rows of every row group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, best = _Index(groups, dim, 1), _Best(x, keys, grps, k, floor)
        for f in frames:
            for first, last in zip(f["first"], f["last"]):
                for i in range(int(first), int(last)):
                    leaves, k2, g2, b, b32 = index.read(i)
                    best.offer(np.arange(len(x)), k2, g2, b, b32, leaves)
        yield best.result()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of every key; copies of a row find the same ones, which count once. One exchange, by key."""
    once = found.repartition("key").groupBy("key", "neighbour").agg(F.max("cosine").alias("cosine"), F.min("leaf").alias("leaf"))
    w = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, key: str, group: str, vector: str, k: int, min_cosine: float = -1.0, recall: float = 0.98, dim: int = 64, sample: int | None = None, calibration: int = CALIBRATION, leaf: int = LEAF, every: int = 1) -> DataFrame:
    """(key, neighbour, cosine, rank) of up to k neighbours of at least *min_cosine*.

    *key* and *group* are SQL expressions; with *every* = m only keys that hash to 0 modulo m are queries, against all rows.
    The result's attributes `visits` and `recall` hold the calibrated number of leaves and the recall it had on the sample.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, key, group, vector, dim)
    n = rows.count()
    sample = sample or min(MAX_SAMPLE, max(SAMPLE, 8 * n // leaf))
    share = min(1.0, 2.0 * sample / max(1, n))  # so many rows at most come to the driver, however many there are
    drawn = valid.withColumn("h", F.xxhash64("key")).where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fit = drawn.orderBy("h", "key").limit(sample).toPandas()
    if not len(fit):
        if share == 1.0:
            return spark.createDataFrame([], "key string, neighbour string, cosine double, rank int")
        fit = valid.limit(sample).toPandas()
    x = _unit(np.stack(fit["vec"].map(np.asarray).to_list()))
    distinct = x[np.unique(_direction(x), return_index=True)[1]]
    tree = Tree(distinct, max(1, min(n // leaf, len(distinct) // 8)))
    files = max(1, min(len(tree.weight), n // 10_000 + 1))
    parts = (np.cumsum(tree.weight) - np.asarray(tree.weight)) * files // max(1, sum(tree.weight))  # leaves in tree order
    path = scratch_path(spark, "knn")
    placed = valid.mapInArrow(_assign(tree, parts.astype(np.int64), dim, k), _PLACED)
    spread = F.when(F.col("light"), F.pmod(F.xxhash64("key"), F.lit(files)).cast("int")).otherwise(F.col("part"))
    placed.repartitionById(files, spread).sortWithinPartitions("leaf", "key").write.option("parquet.block.size", str(max(ROW_GROUP, n * dim * 8 // MOST_GROUPS))).option("compression", "zstd").parquet(path)
    groups, ends, light = [], [0], False
    names = list_files(spark, path)
    footers = spark.createDataFrame([(f,) for f in names], "name string").repartition(max(1, len(names))).mapInPandas(_footers, "name string, i int, low bigint, high bigint, light boolean")
    for r in sorted(footers.collect()):  # one row a row group
        if groups and groups[-1][0] != r["name"]:
            ends.append(len(groups))
        groups.append((r["name"], r["i"], r["low"], r["high"]))
        light |= r["light"]
    ends.append(len(groups))
    spans = [(a, b) for a, b in zip(ends, ends[1:]) if b > a]
    if not spans:
        return spark.createDataFrame([], "key string, neighbour string, cosine double, rank int")
    units = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, first int, last int").repartitionById(len(spans), "i")

    ask = fit.head(calibration)
    truth = _top(units.mapInPandas(_scan(groups, dim, k, min_cosine, x[: len(ask)], ask["key"].to_numpy(object), ask["grp"].to_numpy(object)), _FOUND), k).toPandas()
    visits, reached = min(LEAST_VISITS, len(tree.weight)), 1.0
    if len(truth):
        row = pd.Series(range(len(ask)), index=ask["key"]).groupby(level=0).first()
        order = tree.visits(x[: len(ask)], len(tree.weight))
        turn = np.array([int(np.flatnonzero(order[row[q]] == at)[0]) + 1 for q, at in zip(truth["key"], truth["leaf"])])
        visits = int(np.sort(turn)[max(0, math.ceil(recall * len(turn)) - 1)]) + 1  # one leaf more than the sample needs
        visits = min(max(visits, LEAST_VISITS), len(tree.weight))
        reached = float((turn <= visits).mean())
    found = units.mapInPandas(_search(tree, groups, dim, k, visits, min_cosine, every), _FOUND)
    if light:
        whole = spark.read.parquet(path)
        few = whole.where("light").select("key", "grp", "direction")
        kept = whole.where("NOT light").select("direction", "key", "grp").join(few.select("direction").distinct(), "direction", "left_semi")

        def closure(f: pd.DataFrame) -> pd.DataFrame:
            f = f.drop_duplicates("key").reset_index(drop=True)
            at = sorted(_keep(f["key"].tolist(), f["grp"].tolist(), k))
            return pd.DataFrame({"direction": f["direction"].iloc[at], "neighbour": f["key"].iloc[at], "of": f["grp"].iloc[at]})

        kept = kept.groupBy("direction").applyInPandas(closure, "direction bigint, neighbour string, of string")
        found = materialize(found, "knn-found")
        twin = whole.where("NOT light").groupBy("direction", "grp").agg(F.min("key").alias("twin"))
        same = few.join(twin, ["direction", "grp"]).join(found.select(F.col("key").alias("twin"), "neighbour", "cosine", "leaf"), "twin").where("key <> neighbour")
        found = found.unionByName(same.select("key", "grp", "neighbour", "cosine", "leaf"))
        copies = few.join(kept, "direction").where("grp <> of AND key <> neighbour")
        found = found.unionByName(copies.select("key", "grp", "neighbour", F.lit(1.0).alias("cosine"), F.lit(0).cast("bigint").alias("leaf")))
    out = _top(found, k).select("key", "neighbour", "cosine", "rank")
    out.visits, out.recall = visits, reached
    return out
