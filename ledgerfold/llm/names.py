"""Names of organisations and persons as people type them, and what the names tell about their own words.

No word of a business, of a legal form or of a given name is written down here. `learn` takes them from the names: a word
that stands beside many rare words is common; where a tidied spelling of the same row has another common word instead, the
two mean the same (`matls` and `materials`, `sue` and `susan`, a Japanese word and its translation); a common word that
most names of the same rare word share tells entities apart (`tell`, a line of business, a given name), one that comes and
goes doesn't (`drop`, a legal form, a department). What is left of a name is its root.

Characters are brought to one form by rule: Unicode compatibility forms, case, accents, kana by their sounds, and the
figures 0 and 1 within words to the letters they look like.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import materialize

#: What is typed where there is no name.
PLACEHOLDERS = {"", "-", "n/a", "na", "none", "null", "nil", "unknown", "not available", "not known", "individual", "(individual)", "tbd", "various", "anonymous", "no name", "not provided", "no assignee", "unassigned"}

#: Sounds of kana.
KANA = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o", "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko",
    "サ": "sa", "シ": "si", "ス": "su", "セ": "se", "ソ": "so", "タ": "ta", "チ": "ti", "ツ": "tu", "テ": "te", "ト": "to",
    "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no", "ハ": "ha", "ヒ": "hi", "フ": "hu", "ヘ": "he", "ホ": "ho",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ラ": "ra", "リ": "ri",
    "ル": "ru", "レ": "re", "ロ": "ro", "ワ": "wa", "ヲ": "wo", "ン": "n", "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge",
    "ゴ": "go", "ザ": "za", "ジ": "zi", "ズ": "zu", "ゼ": "ze", "ゾ": "zo", "ダ": "da", "ヂ": "di", "ヅ": "du", "デ": "de",
    "ド": "do", "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo", "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe",
    "ポ": "po", "ヴ": "vu", "ッ": "", "ー": "",
}
_SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo"}
_COMPANY = {"株式会社": " kabushiki kaisha ", "(株)": " kabushiki kaisha ", "有限会社": " yugen kaisha ", "(有)": " yugen kaisha "}
_WORD = re.compile(r"[ァ-ヺー]+|[㐀-鿿]+|[^\W_ァ-ヺー㐀-鿿]+(?:'[^\W_]+)*")
_INNER = re.compile(r"^\s*([\w&.]{2,8})\s*\((.{5,})\)(.*)$")
#: A word is first taken for common from so many names (or this share of all names) on, then if it stands beside so many rare words
#: (and so many for each of its names).
COMMON_NAMES, COMMON_SHARE, BESIDE, BESIDE_SHARE = 12, 0.002, 3, 0.1
LONG_NAME = 12  # in names of more words only neighbours stand beside each other
#: Share of a word's tidied rows that must agree on what it means, and how much oftener than of any word; names of one root that must share a telling word.
AGREE, LIFT, CONSTANT, LEAST = 0.3, 2.5, 0.58, 2
#: Words learnt are at least this share of all names each, so that their table is bounded.
LEAST_SHARE = 1 / 100_000
_SUFFIX = "~"


def plain(raw: str) -> str:
    s = unicodedata.normalize("NFKC", raw).casefold()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) or c in "゙゚")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", s)).strip()


def romanise(text: str) -> str:
    out: list[str] = []
    for ch in text:
        if ch in _SMALL and out and out[-1]:
            out[-1] = out[-1][:-1] + _SMALL[ch]
        else:
            out.append(KANA.get(ch, ch))
    return "".join(out)


def _kana(word: str) -> bool:
    return "ァ" <= word[0] <= "ー"


def raw_words(raw: str | None) -> list[str]:
    """The words of a name, kana as they are; none for nobody."""
    if raw is None:
        return []
    s = plain(raw)
    if s in PLACEHOLDERS or s.strip("().- ") in PLACEHOLDERS or not re.search(r"[^\W\d_]", s):
        return []
    for form, word in _COMPANY.items():
        s = s.replace(form, word)
    inner = _INNER.match(s)
    if inner and _in_order(re.sub(r"\W", "", inner.group(1)), re.sub(r"\W", "", inner.group(2))):  # letters before the name they stand for
        s = f"{inner.group(2)} {inner.group(3)}"
    s = re.sub(r"(?<!\w)(?:\w\.){2,}\w?(?!\w)", lambda m: m.group(0).replace(".", ""), s)
    out = []
    for w in _WORD.findall(s):
        if w.isascii() and not w.isalpha() and re.search("[a-z]", w):
            w = w.replace("0", "o").replace("1", "l")
        out.append(w)
    return out


def _in_order(short: str, long: str) -> bool:
    """Whether the letters of *short* stand in *long* in their order, from its first on."""
    if not short or not long or short[0] != long[0]:
        return False
    it = iter(long)
    return all(c in it for c in short)


def suffixes(word: str) -> list[str]:
    """Ends of a kana word that may be words of their own, the longest first."""
    return [word[i:] for i in range(1, len(word) - 1) if len(word) - i >= 2 and word[i] not in _SMALL and word[i] not in "ーッン"]


class Lexicon(NamedTuple):
    """Common words: what they mean, and whether they tell entities apart. Ends of kana words are kept with a tilde."""

    means: dict[str, str]
    tell: dict[str, float]
    drop: frozenset


EMPTY = Lexicon({}, {}, frozenset())


class Name(NamedTuple):
    root: str  # rare words, run together
    tells: str  # telling words, in order of the alphabet; '' if there are none
    letters: str  # single letters, in their order
    short: bool  # called by a few letters alone

    @property
    def form(self) -> str:
        return f"{self.root}|{self.tells}|{self.letters}" if self.root else ""


NOBODY = Name("", "", "", False)


def common_words(words: list[str], lexicon: Lexicon) -> list[str]:
    """The words with common ones replaced by what they mean, kana split and written by their sounds."""
    out = []
    for w in words:
        if _kana(w) and w not in lexicon.means:
            best = next((s for s in suffixes(w) if _SUFFIX + s in lexicon.means), None)
            if best:
                out += [romanise(w[: -len(best)]), *lexicon.means[_SUFFIX + best].split()]
                continue
        out += [romanise(x) if _kana(x) else x for x in lexicon.means.get(w, w).split()]
    return out


def parse(raw: str | None, tidied: str | None, lexicon: Lexicon, first: dict[str, set[str]] | None = None) -> Name:
    """The parts of a name; *tidied* is another spelling of it, asked only where the name itself tells too little."""
    words = common_words(raw_words(raw), lexicon)
    if not words:
        return NOBODY
    first = first or {}
    root, tells, letters, dropped = [], set(), [], 0
    for i, w in enumerate(words):
        if w in lexicon.drop:
            dropped += 1
        elif w in lexicon.tell:
            tells.add(w)
        elif len(w) == 1:
            if not (i + 1 < len(words) and words[i + 1] in lexicon.drop):  # an article is no initial
                letters.append(w)
        else:
            root.append(w)
    text = "".join(root)
    short = bool(text) and len(text) <= 5 and not tells
    if tidied and (short or not text or not tells):
        other = parse(tidied, None, lexicon)
        if other.root and not other.short:
            if (short or not text) and len(other.root) > len(text) and (not text or _in_order(text, other.root + other.tells.replace(" ", ""))):
                return other
            if not tells and other.tells and edits(text, other.root, 2) <= 2 and (not letters or any(letters[0] in first.get(t, t[0]) for t in other.tells.split())):
                tells, letters = set(other.tells.split()), letters[1:]
    if not text:
        if not tells:
            return NOBODY
        text, tells = "".join(sorted(tells)), set()
    return Name(text, " ".join(sorted(tells)), "".join(letters), short)


def edits(a: str, b: str, limit: int = 2) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment); limit + 1 if greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


def near(a: str, b: str) -> bool:
    """Whether two roots may be one with slips of the hand: two in seven letters, one in fewer."""
    allowed = 2 if min(len(a), len(b)) >= 7 else 1 if min(len(a), len(b)) >= 4 else 0
    return edits(a, b, allowed) <= allowed


def initials(lexicon: Lexicon) -> dict[str, set[str]]:
    """Letters that may stand for a telling word: its own first one and those of its variants."""
    out = {t: {t[0]} for t in lexicon.tell}
    for w, v in lexicon.means.items():
        if v in out and w[0] != _SUFFIX:
            out[v].add(w[0])
    return out


def same_name(a: Name, b: Name, firm_a: str | None = None, firm_b: str | None = None, first: dict[str, set[str]] | None = None) -> bool:
    """Exact check of two names whose vectors are close: nothing they tell may contradict."""
    x, y = set(a.tells.split()), set(b.tells.split())
    if x and y and not (x <= y or y <= x):
        return False
    if a.short or b.short:
        few, full = (a, b) if a.short else (b, a)
        if few.root == full.root:
            return True
        return bool(firm_a) and firm_a == firm_b and _in_order(few.root, full.root + full.tells.replace(" ", "")) or (a.short == b.short and bool(firm_a) and firm_a == firm_b and few.root[:2] == full.root[:2])
    if not near(a.root, b.root):
        return False
    p, q = a.letters, b.letters
    if bool(x) != bool(y):  # initials of the one may stand for the words of the other
        bare, told = (p, y) if y else (q, x)
        if bare:
            at = next((i for i, c in enumerate(bare) if any(c in (first or {}).get(t, t[0]) for t in told)), None)
            if at is None:
                return False
            rest = bare[:at] + bare[at + 1 :]
            p, q = (rest, q) if y else (p, rest)
    elif not x and p and q and p[0] != q[0]:
        return False
    return not (p and q and not set(p) & set(q))


@lru_cache(maxsize=200_000)
def _words(raw: str) -> tuple[str, ...]:
    return tuple(raw_words(raw))


def _table(df: DataFrame, names: DataFrame, schema: str, rows) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for name, tidied in zip(f["name"], f["tidied"]) for r in rows(name, tidied)], columns=[c.split()[0] for c in schema.split(", ")])

    return names.mapInPandas(run, schema)


def _stats(name: str, tidied: str | None) -> Iterator[tuple]:
    """('beside', word, neighbour), ('means', word, other), ('open', word, '') and ('name', word, '') of one name."""
    words = _words(name)
    for i, w in enumerate(words):
        yield "name", w, ""
        for x in {*words[max(0, i - 1) : i], *words[i + 1 : i + 2]} if len(words) > LONG_NAME else set(words):
            if len(x) > 1 and x != w:
                yield "beside", w, x
    other = {romanise(w) if _kana(w) else w for w in _words(tidied)} if tidied else set()
    sounds = {w: romanise(w) if _kana(w) else w for w in words}
    new, old = other - set(sounds.values()), {w for w in sounds if sounds[w] not in other}
    if 0 < len(new) <= 8 and len(old) <= 8:  # names that differ in more words teach nothing
        for w in old:
            ends = [_SUFFIX + s for s in suffixes(w) if romanise(w[: -len(s)]) in new] if _kana(w) else []  # the start is told as a word
            for x in ends or ([] if _kana(w) else [w]):
                yield "open", x, ""
                for v in new:
                    yield "means", x, v


def learn(names: DataFrame) -> Lexicon:
    """What the distinct names(name, tidied) tell about their words; of bounded size, from counts over all names."""
    n = names.count()
    least = max(LEAST, n * LEAST_SHARE)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for name, tidied in zip(f["name"], f["tidied"]) for r in _stats(name, tidied)], columns=["what", "word", "other"]).value_counts().rename("n").reset_index()

    counts = materialize(names.mapInPandas(counted, "what string, word string, other string, n bigint").groupBy("what", "word", "other").agg(F.sum("n").alias("n")), "name-words")
    total = counts.where("what = 'name' AND length(word) > 1")
    common = total.where(F.col("n") >= max(COMMON_NAMES, COMMON_SHARE * n)).select("word")
    beside = counts.where("what = 'beside' AND length(word) > 1").select("word", "other")
    for needed in (2 * BESIDE, BESIDE):  # words beside rare ones are common; then rare ones are counted anew
        rare = beside.join(common.select(F.col("word").alias("other")), "other", "left_anti")
        spread = rare.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= needed)
        common = materialize(total.where(F.col("n") >= least).join(spread, "word").where(F.col("k") >= BESIDE_SHARE * F.col("n")).select("word"), "name-common")
    # what a word means: the other common word that most tidied spellings have in its place
    opened = counts.where("what = 'open'").select("word", F.col("n").alias("n_open"))
    means = counts.where("what = 'means'").select("word", F.col("other").alias("v"), F.col("n").alias("c")).where(F.col("c") >= least)
    # a legal form stands in the place of any word by chance: what it means must be told far oftener than of other words
    usual = counts.where("what = 'means'").groupBy(F.col("other").alias("v")).agg(F.sum("n").alias("usual"))
    every = opened.agg(F.sum("n_open").alias("every"))  # one row
    means = means.join(common.select(F.col("word").alias("v")), "v").join(opened, "word").join(usual, "v").join(F.broadcast(every))
    means = means.where((F.col("c") >= AGREE * F.col("n_open")) & (F.col("c") * F.col("every") >= LIFT * F.col("usual") * F.col("n_open")))
    means = means.join(common.withColumn("known", F.lit(True)), "word", "left").where("known OR word RLIKE '^[^ -}]'")
    told = means.select("word", "v", "c").toPandas()  # at most some 1 / LEAST_SHARE rows
    return _decide(told, [r[0] for r in common.collect()], names)


def _decide(told: pd.DataFrame, common: list[str], names: DataFrame) -> Lexicon:
    best: dict[str, list[tuple]] = {}
    for w, v, c in zip(told["word"], told["v"], told["c"]):
        best.setdefault(w, []).append((c, _in_order(w, v), -len(v), v))
    means = {}
    for w, options in best.items():
        top = max(options)
        # a word without spaces may stand for two
        means[w] = top[-1] if w.isascii() and w[0] != _SUFFIX else " ".join(sorted(v for c, *_, v in options if c >= 0.8 * top[0])[:3])
    for w in list(means):  # chains lead to their end
        seen = {w}
        while means[w] in means and means[w] not in seen:
            seen.add(means[w])
            means[w] = means[means[w]]
    means = {w: v for w, v in means.items() if means.get(v, v) == v and w != v}
    known = {v for w in [*common, *means] for v in means.get(w, w).split()}
    draft = Lexicon(means, dict.fromkeys(known, 1.0), frozenset())

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name in f["name"]:
                words = common_words(list(_words(name)), draft)
                root = "".join(w for w in words if w not in known and len(w) > 1)
                if root:
                    rows += [(root, w) for w in {w for w in words if w in known}] + [(root, "")]
            yield pd.DataFrame(rows, columns=["root", "word"]).value_counts().rename("n").reset_index()

    counts = names.mapInPandas(shared, "root string, word string, n bigint").groupBy("root", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "name-roots")
    size = counts.where("word = ''").select("root", F.col("n").alias("size"))
    constant = counts.where("word <> ''").join(size, "root").groupBy("word").agg(F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)), F.sum(F.col("n") * (F.col("size") - 1))).alias("constancy"))
    share = {r["word"]: r["constancy"] for r in constant.collect()}
    tell = {w: float(share[w] if share.get(w) is not None else 1.0) for w in known if share.get(w) is None or share[w] >= CONSTANT}
    return Lexicon(means, tell, frozenset(known - set(tell)))
