"""Evaluation texts leaking into training text.

Method: the test items are a BM25 inverted index with block maxima; impacts are divided by the item's own score, so a score
is the share of an item that a passage covers.
Every document is read whole: the items that all its terms together cover to the threshold are the only ones that a passage
can; every passage is a query for them. As in block-max WAND, essential terms (without which no item can reach the threshold)
are the pivots and blocks are left out by the sum of their maxima; there are no cursors over postings, since all of a
passage's terms are at hand and every item above the threshold is wanted, not the best few. A retrieved item is verified by aligning its words
with the passage in order: at least half of them must be there, and of the names and figures in the part covered most.

The index holds the test items only (a held-out set), at most about `max_items` at once, and goes to every task.

Defined results: null and empty texts hold nothing; repeated documents and items are compared once a (doc_id, item_id);
items without words are never found; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, COVER, NAMES, WINDOW, BLOCK, FEW, MAX_ITEMS = 0.35, 0.5, 0.5, 192, 32, 12, 200_000
_CJK = "぀-ヿ㐀-䶿一-鿿"
_TOKEN = re.compile(rf"[^\W_{_CJK}]+|[{_CJK}]")
_INLINE = re.compile(r"</?(?:b|i|em|strong|u|span|font|a|sup|sub)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_HYPHEN = re.compile(r"[-‐‑](?<=\w.)\s*[\r\n \x85]+[\s>|*#]*(?=\w)")
_HIDDEN = re.compile("[­​-‏⁠﻿�\x00-\x08\x0e-\x1f]")
_CONTROLS = dict.fromkeys([*range(9), *range(14, 32)])
_STRANGE = re.compile("[Ͱ-ϿЀ-ӿ]")
#: Letters of other scripts that look like Latin ones.
_LIKE = str.maketrans("асеорхуіјѕԁһӏкмтвнгАВЕКМНОРСТХУІЈЅαοερτνικ", "aceopxyijsdhlkmtbhrABEKMHOPCTXYIJSaoeptvik")


@lru_cache(maxsize=1 << 16)
def _base(c: str) -> str:
    """A character without its accents (voicing marks of kana stay); '' for one that isn't seen."""
    return _HIDDEN.sub("", unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x) or x in "゙゚")))


def plain(text: str) -> str:
    """One form for all ways of typing the same words."""
    if "&" in text:
        text = html.unescape(html.unescape(text)) if "&amp;" in text else html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _STRANGE.search(text):
            text = text.translate(_LIKE)
        for c in set(text):
            if not "\x1f" < c <= "\x7f" and (b := _base(c)) != c:
                text = text.replace(c, b)
    else:
        text = text.translate(_CONTROLS)
    if "\n" in text or "\r" in text or " " in text or "\x85" in text:
        text = _HYPHEN.sub("", text)
    return text.lower()


def words(text: str) -> list[str]:
    return _TOKEN.findall(text)


def terms(tokens: list[str]) -> set[str]:
    """Index terms: words, and runs of three characters of scripts written without spaces."""
    out = {t for t in tokens if not ("぀" <= t[0] <= "鿿")}
    for a, b, c in zip(tokens, tokens[1:], tokens[2:]):
        if "぀" <= a[0] <= "鿿" and "぀" <= b[0] <= "鿿" and "぀" <= c[0] <= "鿿":
            out.add(a + b + c)
    return out


class ItemIndex:
    """Test items by term, in blocks with their greatest impact; `essential` finds the terms in a text."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, k1: float = 1.2, b: float = 0.75) -> None:
        self.threshold, self.ids, self.tokens = threshold, [], []
        for item, text in sorted(items):
            t = words(plain(text))
            if t:
                self.ids.append(item)
                self.tokens.append(t)
        sets = [terms(t) or set(t) for t in self.tokens]
        df = Counter(t for s in sets for t in s)
        n, mean = len(sets), sum(map(len, self.tokens)) / max(1, len(sets))
        self.df = df
        self.word_df = Counter(w for t in self.tokens for w in set(t))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.impacts: list[dict[str, float]] = []
        essential: set[str] = set()
        for i, s in enumerate(sets):
            norm = k1 * (1 - b + b * len(self.tokens[i]) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (k1 + 1) / (1 + norm) for t in s}
            own = sum(impact.values()) or 1.0
            self.impacts.append({t: v / own for t, v in impact.items()})
            rest = 1.0
            for t, v in sorted(impact.items(), key=lambda x: (-x[1], x[0])):
                postings[t].append((i, v / own))
                if rest >= threshold:
                    essential.add(t)
                rest -= v / own
        self.postings = dict(postings)
        self.lists = {t: (np.array([i for i, _ in p]), np.array([v for _, v in p])) for t, p in postings.items()}
        self.blocks: dict[str, dict[int, float]] = {}
        for t, p in self.postings.items():
            best = self.blocks.setdefault(t, {})
            for item, v in p:
                best[item // BLOCK] = max(best.get(item // BLOCK, 0.0), v)
        #: Items by essential term; an item that reaches the threshold holds one of its own at least.
        self.essential = {t: [i for i, _ in self.postings[t]] for t in essential}

    def candidates(self, query: set[str]) -> list[int]:
        """The items whose share covered by the terms of a whole document is at least the threshold: no passage covers more."""
        known = query & self.lists.keys()
        if known.isdisjoint(self.essential):
            return []
        at, v = (np.concatenate(x) for x in zip(*(self.lists[t] for t in known)))
        return np.flatnonzero(np.bincount(at, v) >= self.threshold - 1e-9).tolist()

    def retrieve(self, query: set[str], items: list[int]) -> list[int]:
        """Those of the items (in order) whose share covered by the query is at least the threshold: block-max WAND.

        Only items on the lists of the essential terms met can be pivots (the other lists alone prove nothing); a block of
        which many items are asked is left out where the sum of the block maxima of all terms of the query stays below the
        threshold. An item's share is summed over its own terms, far fewer than those of a passage.
        """
        known = query & self.postings.keys()
        if not items or known.isdisjoint(self.essential):
            return []
        found: list[int] = []
        at, least = 0, self.threshold - 1e-9
        while at < len(items):
            block = items[at] // BLOCK
            end = bisect_left(items, (block + 1) * BLOCK, lo=at)
            if end - at <= FEW or sum(self.blocks[t].get(block, 0.0) for t in known) >= least:
                for item in items[at:end]:
                    if sum([v for t, v in self.impacts[item].items() if t in known]) >= least:
                        found.append(item)
            at = end
        return found

    def retriever(self, items: list[int], query: set[str]):
        """What `retrieve` gives for parts of one document; with many items their impacts are laid out as a matrix once."""
        if len(items) <= FEW:
            return lambda part: self.retrieve(part, items)
        row = {t: i for i, t in enumerate(t for t in query if t in self.postings)}
        impact = np.zeros((len(row) + 1, len(items)))
        for j, item in enumerate(items):
            for t, v in self.impacts[item].items():
                if t in row:
                    impact[row[t], j] = v
        names, least, essential = np.asarray(items), self.threshold - 1e-9, self.essential

        def find(part: set[str]) -> list[int]:
            if part.isdisjoint(essential):
                return []
            rows = [row[t] for t in part if t in row]
            return names[impact[rows].sum(0) >= least].tolist()

        return find

    def holds(self, item: int, passage: list[str]) -> bool:
        """Exact check: half of the item's words in their order, with most of the names and figures of that part."""
        own = self.tokens[item]
        where: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(own):
            where[w].append(i)
        special = [self.special(own, i) for i in range(len(own))]
        # where the item would begin if it stood by the names met; the place most of them agree on
        starts = sorted(place - i for place, w in enumerate(passage) for i in where.get(w, ()) if special[i]) or sorted(place - i for place, w in enumerate(passage) for i in where.get(w, ()))
        if not starts:
            return False
        slack = 4 + len(own) // 6
        best = max(range(len(starts)), key=lambda a: bisect_left(starts, starts[a] + slack) - a)
        begin = max(0, starts[best] - slack)
        passage = passage[begin : starts[best] + len(own) + 2 * slack]
        # longest increasing run of matches; positions of each word tried from the last to the first
        tails: list[int] = []
        ends: list[tuple] = []
        for w in passage:
            for i in reversed(where.get(w, ())):
                k = bisect_left(tails, i)
                node = (i, ends[k - 1] if k else None)
                if k == len(tails):
                    tails.append(i)
                    ends.append(node)
                else:
                    tails[k] = i
                    ends[k] = node
        if len(tails) < COVER * len(own):
            return False
        matched, node = set(), ends[-1]
        while node:
            matched.add(node[0])
            node = node[1]
        part = [i for i in range(min(matched), max(matched) + 1) if special[i]]
        return not part or sum(i in matched for i in part) >= NAMES * len(part)

    def special(self, own: list[str], i: int) -> bool:
        """Names and figures: words of hardly any other item, and numbers."""
        w = own[i]
        if w.isdigit() or len(w) > 1 and self.word_df[w] <= 2:
            return True
        if "぀" <= w[0] <= "鿿":
            return any(0 <= s and s + 3 <= len(own) and self.df.get("".join(own[s : s + 3]), 99) <= 2 and all("゠" <= c[0] <= "ヿ" for c in own[s : s + 3]) for s in (i - 2, i - 1, i))
        return False


def leaks(index: ItemIndex, text: str, window: int = WINDOW) -> list[int]:
    """Positions of the items that a document holds."""
    text = plain(text)
    tokens = words(text)
    query = set(tokens) if text.isascii() else terms(tokens)
    items = index.candidates(query)
    if not items:
        return []
    retrieve = index.retriever(items, query)
    step = window // 2
    found: set[int] = set()
    for s in range(0, max(1, len(tokens) - step), step):
        passage = tokens[s : s + window]
        for item in retrieve(set(passage) if text.isascii() else terms(passage)):
            if item not in found:
                reach = len(index.tokens[item])
                if index.holds(item, tokens[max(0, s - reach) : s + window + reach]):
                    found.add(item)
    return sorted(found)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id) of every document and test item it holds.

    More than *max_items* items are taken in sets of about that size by hash, each with an index and a scan of its own; what
    counts as a name is then judged within a set.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    known = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    sets = max(1, -(-known.count() // max_items))
    found = None
    for k in range(sets):
        rows = known.where(F.pmod(F.xxhash64("i"), F.lit(sets)) == k).collect()
        index = ItemIndex([(r[0], r[1]) for r in rows], threshold)
        one = source.mapInPandas(_searched(docs.sparkSession.sparkContext.broadcast(index)), "doc_id bigint, item_id bigint")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _searched(ship):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = ship.value
        for f in frames:
            out = [(d, ix.ids[i]) for d, t in zip(f["doc_id"], f["text"]) for i in leaks(ix, t)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return run
