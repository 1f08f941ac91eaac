"""Filling fixed-capacity containers with items: best-two-fit.

Method: texts are measured in tokens of a public tokenizer; one longer than the capacity is cut into full containers and a
rest, no other is split. Containers are filled in parallel, every task for a hash share of the items: greedily with the
longest item that fits, then the smallest item of the container is replaced by two unpacked ones that together fit the
gap so widened more tightly, if there are such. Tasks close the containers that are full enough; the items of the others
are shuffled anew and packed in the next round, until one task holds the rest or a round leaves nearly as much as it got;
then every task closes what it has. A task never gets more than about *items_per_task* items.

Work in a task is on counts by length, so its memory is bounded by the capacity and by the ids of its own items.

Defined results: null and empty texts have no tokens and go nowhere; repeated rows are items of their own; an empty table
gives an empty result; further columns are ignored. The result has one row a piece: container, item, piece, tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # unless the session names another in ledgerfold.tokenizer
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
FULL = 0.995
ITEMS_PER_TASK, LEVELS = 50_000, 6


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, tokens) of every text that has any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for f in frames:
            yield pd.DataFrame({"item": f["item"], "tokens": [len(enc.encode_ordinary(t)) for t in f["text"]]})

    source = docs.select(F.col(doc_id).cast("bigint").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    return source.mapInPandas(run, "item bigint, tokens bigint")


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-two-fit over one set of lengths (1..capacity); the containers as lists of positions."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    start = np.r_[0, np.cumsum(count)]  # the items of length n are order[start[n]:start[n + 1]]
    taken = np.zeros(capacity + 1, np.int64)
    below = np.zeros(capacity + 1, np.int64)  # the greatest length <= i that is left
    np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0), out=below)

    def change(n: int, by: int) -> None:
        count[n] += by
        if by < 0 and count[n] == 0:
            end = n
            while end <= capacity and below[end] == n:
                end = end + int(np.searchsorted(below[end:], n, side="right"))
            below[n:end] = below[n - 1]
        elif by > 0 and count[n] == by:
            part = below[n:]
            part[: int(np.searchsorted(part, n))] = n

    out: list[list[int]] = []
    left = len(lengths)
    while left:
        gap, bin_ = capacity, []
        while gap and (n := int(below[gap])):
            change(n, -1)
            bin_.append(n)
            gap -= n
        if gap and bin_:
            smallest = bin_[-1]
            room = gap + smallest
            have = np.flatnonzero(count[: room + 1])
            if len(have):
                mate = below[room - have]
                # an item can't be its own mate if it is the last of its length
                single = (mate == have) & (count[have] < 2)
                mate = np.where(single, np.where(have > 0, below[have - 1], 0), mate)
                sums = np.where(mate > 0, have + mate, 0)
                best = int(sums.argmax())
                if sums[best] > smallest and sums[best] <= room:
                    change(smallest, 1)
                    bin_.pop()
                    for n in (int(have[best]), int(mate[best])):
                        change(n, -1)
                        bin_.append(n)
        members = []
        for n in bin_:
            members.append(int(order[start[n] + taken[n]]))
            taken[n] += 1
        left -= len(members)
        out.append(members)
    return out


def _pack_task(capacity: int, least: int, prefix: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        f = pd.concat(parts, ignore_index=True).sort_values(["tokens", "item", "piece"], kind="stable", ignore_index=True)
        if not len(f):
            return
        share, lengths = int(f["share"].iloc[0]), f["tokens"].to_numpy(np.int64)
        bins = pack_lengths(lengths, capacity)
        name = np.full(len(f), None, object)
        for i, members in enumerate(bins):
            if lengths[members].sum() >= least:
                name[members] = f"{prefix}-{share}-{i}"
        yield pd.DataFrame({"container": name, "item": f["item"], "piece": f["piece"], "tokens": f["tokens"]})

    return run


def pack(items: DataFrame, capacity: int, full: float = FULL, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(container, item, piece, tokens) of items(item, tokens)."""
    n = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - n * capacity
    sizes = F.concat(F.when(n > 0, F.array_repeat(F.lit(capacity).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    pieces = materialize(items.where("tokens > 0").select("item", F.posexplode(sizes).alias("piece", "tokens")), "pack-items")
    whole = pieces.where(F.col("tokens") == capacity).select(F.concat(F.lit("w-"), F.monotonically_increasing_id().cast("string")).alias("container"), "item", "piece", "tokens")
    open_, done, level, before = pieces.where(F.col("tokens") < capacity), [whole], 0, None
    while True:
        left = open_.count()
        if not left:
            break
        tasks = max(1, -(-left // items_per_task))
        last = tasks == 1 or level >= LEVELS or (before is not None and left > 0.9 * before)  # then every task closes all it has
        share = F.pmod(F.xxhash64("item", "piece", F.lit(level)), F.lit(tasks)).cast("int")
        placed = open_.withColumn("share", share).repartition(tasks, "share")
        packed = placed.groupBy("share").applyInPandas(_grouped(_pack_task(capacity, 0 if last else int(full * capacity), f"r{level}")), "container string, item bigint, piece int, tokens bigint")
        packed = materialize(packed, f"pack-{level}")
        done.append(packed.where("container IS NOT NULL"))
        if last:
            break
        open_, level, before = packed.where("container IS NULL").drop("container"), level + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _grouped(task):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        return next(iter(task(iter([f]))), pd.DataFrame({"container": [], "item": [], "piece": [], "tokens": []}))

    return run
