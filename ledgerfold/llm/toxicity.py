"""Abusive, hateful or sexual content: non-negative positive-unlabelled learning.

Method: texts are brought to one form (case, look-alike letters, digits for letters, stretched and spaced words) and cut
into sentences; features are words, pairs of words and, in scripts without spaces, runs of two and three characters. A
linear classifier is fitted in numpy on confirmed toxic documents and unlabelled ones, both bounded samples by hash, under
the risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),  pi being the prior of toxic sentences, re-estimated from the scores
between rounds. Labels of clean documents play no part. As an abusive document mostly holds other sentences too, positives
are the sentences of toxic documents that stand out: at first by the log odds of their features, then by the model of the
round before; a document without any is taken for wrongly labelled. A document scores as its worst sentence. All documents
are scored, whole; a sentence is scored in full only if the sum of its positive weights could make it the worst one.

Defined results: null and empty texts score 0; repeated rows are scored alike and appear once a doc_id where asked for
ids; null labels are no labels; with no confirmed toxic document everything scores 0; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.leakage import plain

TOXIC_DOCS, OTHER_DOCS, FEATURES = 3_000, 8_000, 1 << 17
COMMON, LIFT = 20, 4.0  # a feature is used if so many sample documents have it, or if it is so much more frequent in toxic ones
USUAL = (0.99, 0.995)  # what stands out among sentences: quantiles of unlabelled ones, by log odds and by a fitted model
_LEET = str.maketrans("013457$@!", "oieasttai")  # 5 stands for s, so $ is the other of the two it may mean
_DIGIT_LETTER = re.compile(r"[013457$@](?:(?<=[a-z].)[013457$@]*[a-z]|[013457$@][a-z]\$)")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_MIXED = re.compile(r"[\w$@']*[013457$@][\w$@']*")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_LETTERS = re.compile(r" [^\W\d_] ?['’]? [^\W\d_] ")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ?['’]? ){2,}[^\W\d_](?![^\W_])")
_ZERO, _END = repeat(0.0), 1e9
_MARK = "."
_TOKEN = re.compile(r"[^\W_぀-ヿ㐀-鿿]+(?:'[a-z]+)?|[぀-ヿ㐀-鿿]+|[.!?。！？\n\r\x85]")
_PLAIN = {i: chr(i) if chr(i).isalnum() or chr(i) == "'" else _MARK if chr(i) in ".!?\n\r" else " " for i in range(128)}


def _unspace(m: re.Match) -> str:
    return m.group(0).replace(" ", "")


def _letters(m: re.Match) -> str:
    t = m.group(0)
    return t.translate(_LEET) if sum("a" <= c <= "z" for c in t) >= 2 else t


def tidy(text: str) -> str:
    t = plain(text)
    if _DIGIT_LETTER.search(t):
        t = _MIXED.sub(_letters, t)
    if any(map(t.__contains__, _TRIPLES)):
        t = _STRETCH.sub(r"\1", t)
    if _LETTERS.search(t):
        t = _SPACED.sub(_unspace, t)
    return t


def tokens(text: str) -> list[str]:
    """Words of a tidied text, with a mark at the end of every sentence."""
    if text.isascii():
        t = text.translate(_PLAIN)
        if "'" in t:
            t = f" {t} ".replace("' ", " ").replace(" '", " ")
        return t.replace(_MARK, " . ").split()
    return [_MARK if not w[0].isalnum() else w for w in _TOKEN.findall(text)]


def sentences(text: str) -> list[list[str]]:
    """The words of every sentence."""
    out: list[list[str]] = [[]]
    for w in tokens(tidy(text)):
        if w != _MARK:
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def features(words: list[str]) -> set[str]:
    out, before = set(), _MARK
    for w in words:
        if "぀" <= w[0] <= "鿿":
            out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
        else:
            out.add(w)
            out.add(f"{before} {w}")
            before = w
    return out


class _Rows:
    """Sparse rows: which features a sentence has."""

    def __init__(self, rows: list[np.ndarray], place: np.ndarray) -> None:
        """*rows* hold numbers of features, *place* their columns, -1 for those that aren't used."""
        self.n = len(rows)
        row = np.repeat(np.arange(self.n), np.fromiter(map(len, rows), np.int64, self.n))
        col = place[np.concatenate(rows)] if rows else np.empty(0, np.int64)
        self.row, self.col = row[col >= 0], col[col >= 0]

    def score(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + b

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nnpu(positive: _Rows, unlabelled: _Rows, size: int, prior: float, epochs: int = 80, rate: float = 0.3, ridge: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss."""
    w, b = np.zeros(size), -2.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, epochs + 1):
        fp, fu = positive.score(w, b), unlabelled.score(w, b)
        up, uu = _sigmoid(fp), _sigmoid(fu)
        # negative risk of the unlabelled, corrected for the toxic ones among them
        corrected = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() if unlabelled.n else 0.0
        sign = 1.0 if corrected >= 0 else -1.0  # below zero the step goes back up, as the method wants
        gu = sign * uu / max(1, unlabelled.n)
        gp = prior * (up - 1 - sign * up) / max(1, positive.n)
        g = positive.gradient(gp, size) + unlabelled.gradient(gu, size) + ridge * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-7)
    return w, b


def _numbered(docs: Iterable[list[set[str]]], numbers: dict[str, int]) -> list[list[np.ndarray]]:
    """Documents with their features as numbers, so that the driver holds little of them; new features get the next number."""
    return [[np.fromiter((numbers.setdefault(f, len(numbers)) for f in sorted(s)), np.int32, len(s)) for s in d] for d in docs]


def _document_counts(docs: list[list[np.ndarray]], size: int) -> np.ndarray:
    out = np.zeros(size)
    for d in docs:
        if d:
            out[np.unique(np.concatenate(d))] += 1
    return out


def fit(toxic: Iterable[list[set[str]]], other: Iterable[list[set[str]]], rounds: int = 3) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, from documents given as lists of sentences of features."""
    numbers: dict[str, int] = {}
    toxic, other = _numbered(toxic, numbers), _numbered(other, numbers)
    in_toxic, df = (_document_counts(d, len(numbers)) for d in (toxic, other))
    df = df + in_toxic
    share = len(toxic) / max(1, len(toxic) + len(other))
    told = (in_toxic >= 2) & (in_toxic >= LIFT * share * df)
    names = np.array(list(numbers), object)
    kept = np.array(sorted(np.flatnonzero(told | (df >= COMMON)).tolist(), key=lambda i: (not told[i], -df[i], names[i]))[:FEATURES], np.int64)
    size = len(kept)
    if not toxic or not size:
        return {}, -30.0
    place = np.full(len(numbers), -1, np.int64)
    place[kept] = np.arange(size)
    vocabulary = dict(zip(names[kept], range(size)))

    def rows(items: list[np.ndarray]) -> _Rows:
        return _Rows(items, place)

    other_s = rows([s for d in other for s in d])
    every = [s for d in toxic for s in d]
    toxic_s = rows(every)
    owner = np.repeat(np.arange(len(toxic)), [len(d) for d in toxic])
    # first picture: log odds of every feature between toxic and other documents, a document's own mention left out
    n_toxic, n_rest = len(toxic), len(other)
    a, d = in_toxic[kept], df[kept]
    odds = lambda x: np.log((x + 0.5) / (n_toxic + 1)) - np.log((d - a + 0.5) / (n_rest + 1))
    first = np.maximum(odds(a), 0)
    # sentences of runs of characters have more features than those of words, so each kind has its own measure
    runs = np.array(["぀" <= f[0] <= "鿿" for f in vocabulary])
    kind_t, kind_o = ((r.score(runs.astype(float), 0.0) > 0).astype(int) for r in (toxic_s, other_s))

    def usual_of(s: np.ndarray, share: float, least: float) -> np.ndarray:
        return np.array([max(least, float(np.quantile(s[kind_o == k], share))) if (kind_o == k).any() else least for k in (0, 1)])[kind_t]

    scores, usual = toxic_s.score(np.maximum(odds(np.maximum(a - 1, 0)), 0), 0.0), usual_of(other_s.score(first, 0.0), USUAL[0], 0.0)
    w, b = np.zeros(size), 0.0
    for turn in range(rounds):
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, owner, scores)
        chosen = scores > usual
        if not chosen.any():
            chosen = scores >= best[owner]
        now = other_s.score(w, b) if turn else other_s.score(first, 0.0)
        # unlabelled sentences above the middle of the positives hold half of the toxic ones among them, and hardly any other
        prior = min(0.05, max(0.0005, 2 * float((now > np.median(scores[chosen])).mean()) if other_s.n else 0.01))
        last = w, b
        w, b = nnpu(rows([every[i] for i in np.flatnonzero(chosen)]), other_s, size, prior)
        scores, usual = toxic_s.score(w, b), usual_of(other_s.score(w, b), USUAL[1], -1.5)
    if rounds > 1:  # one round picks many positives, the next few: the mean of both models is steadier than either
        w, b = (w + last[0]) / 2, (b + last[1]) / 2
    return {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 0.02}, b


class Scorer:
    """Scores texts with fitted weights, kept in tables by word, by pair of words and by run of characters."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.bias, self.single, self.pairs, self.runs = bias, {}, {}, {}
        for f, x in weights.items():
            before, gap, w = f.partition(" ")
            if gap:
                self.pairs[before, w] = x
            elif "぀" <= f[0] <= "鿿":
                self.runs[f] = x
            else:
                self.single[f] = x
        #: What a word or a pair can add at most.
        self.most = {w: x for w, x in self.single.items() if x > 0} | {_MARK: _END}
        self.most_pairs = {p: x for p, x in self.pairs.items() if x > 0}

    def sentence(self, words: list[str]) -> float:
        total = self.bias
        cjk = [w for w in words if "぀" <= w[0] <= "鿿"]
        if cjk:
            words = [w for w in words if not "぀" <= w[0] <= "鿿"]
            total += sum(map(self.runs.get, {w[i : i + n] for w in cjk for n in (2, 3) for i in range(len(w) - n + 1)}, _ZERO))
        return total + sum(map(self.single.get, set(words), _ZERO)) + sum(map(self.pairs.get, set(zip([_MARK, *words], words)), _ZERO))

    def logit(self, text: str, least: float = -np.inf) -> float:
        """The worst sentence's score; below *least*, anything below it."""
        words = [*tokens(tidy(text)), _MARK]
        hits = np.fromiter(map(self.most.get, words, _ZERO), float, len(words))
        ends = np.flatnonzero(hits == _END)
        hits[ends] = 0.0
        hits += np.fromiter(map(self.most_pairs.get, zip([_MARK, *words], words), _ZERO), float, len(words))
        bounds = np.diff(np.cumsum(hits)[ends], prepend=0.0) + (self.bias + 1e-9)
        if not text.isascii() and any("぀" <= w[0] <= "鿿" for w in words):  # their runs are in no bound
            bounds[:] = np.inf
        worst = -np.inf
        likely = np.flatnonzero(bounds >= least)
        for i in likely[np.argsort(-bounds[likely], kind="stable")].tolist():
            if bounds[i] < worst:
                break
            start = ends[i - 1] + 1 if i else 0
            if ends[i] > start:
                worst = max(worst, self.sentence(words[start : ends[i]]))
        return worst

    def score(self, text: str | None, floor: float = 0.0) -> float:
        """The chance that the text is abusive; one below *floor* may be given as 0."""
        if not text:
            return 0.0
        worst = self.logit(text, float(np.log(floor / (1 - floor))) if floor > 0 else -np.inf)
        return 0.0 if worst == -np.inf else float(_sigmoid(np.float64(worst)))


def labelled(labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    """(doc_id, y): the majority of a document's labels; ties and null labels decide nothing."""
    votes = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(toxic).cast("double").alias("t"), *[c for c in labels.columns if c == "annotator"]).where("doc_id IS NOT NULL AND t IS NOT NULL").distinct()
    return votes.groupBy("doc_id").agg(F.avg("t").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, toxic: str) -> Scorer:
    """A scorer fitted on bounded samples: confirmed toxic and other documents, both by hash of the id, read in one scan."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = [r[0] for r in labelled(labels, label_id, toxic).where("y = 1").orderBy(h, "doc_id").limit(TOXIC_DOCS).select("doc_id").collect()]
    if not ids:
        return Scorer({}, -30.0)
    share = min(1.0, 1.2 * OTHER_DOCS / max(1, docs.count()))  # thinned by hash, so that a bounded number comes to the driver
    confirmed = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id bigint").withColumn("y", F.lit(1)))  # at most TOXIC_DOCS rows
    drawn = d.join(confirmed, "doc_id", "left").where(F.col("y").isNotNull() | (h < int(share * (1 << 30)))).select("doc_id", "text", "y", h.alias("h")).dropDuplicates(["doc_id"]).toPandas().sort_values(["h", "doc_id"])
    cut = lambda texts: ([features(s) for s in sentences(t)] for t in texts)
    marked = drawn["y"].notna()
    other = drawn[drawn["h"] < int(share * (1 << 30))]["text"][:OTHER_DOCS]  # unlabelled: a few confirmed ones among them belong there
    return Scorer(*fit(cut(drawn[marked]["text"]), cut(other)))


def score_documents(docs: DataFrame, doc_id: str, text: str, scorer: Scorer, *keep: str, floor: float = 0.0) -> DataFrame:
    """(doc_id, score, *keep) of every document; scores below *floor* may be given as 0."""
    ship = docs.sparkSession.sparkContext.broadcast(scorer)
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *keep)
    schema = "doc_id bigint, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = ship.value
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": [s.score(t, floor) for t in f["text"]]} | {c: f[c] for c in keep})

    return d.mapInPandas(run, schema)
