"""Variant spellings of names typed by people.

Method: what the names tell about their own words (see names.py) brings every name to a root, telling words and letters;
names that come out alike are one item of the join. Items are weighted vectors of character n-grams of the root, of the
telling words, and of the firm id most of their rows bear together with the first consonants; n-grams weigh tf-idf over all
items. A distributed sparse join finds all pairs of at least *threshold* cosine (all partners, not only the top n; items
meet at each n-gram with the more frequent ones after it, under a bound that loses none); an exact check drops pairs that contradict each other;
average-linkage clustering on the cosines, weighted by rows, groups what is left. A pair below the threshold is no pair.

Defined results: null names and placeholders mean nobody; repeated rows only add weight; an empty table gives an empty
result; other columns are ignored. Very long names are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.clusters import average_linkage
from ledgerfold.llm.names import Lexicon, Name, initials, learn, parse, same_name
from ledgerfold.session import materialize

THRESHOLD, CUT, GRAM = 0.25, 0.12, 3
#: How much a telling word and a firm id weigh beside an n-gram of the root, and n-grams of a name of a few letters.
TELL_WEIGHT, FIRM_WEIGHT, SHORT_WEIGHT = 2.0, 2.0, 0.5
#: Meetings of forms that are summed up at once.
MEETINGS = 1_000_000
_PARTS = "form string, root string, tells string, letters string, short boolean"


def with_parts(names: DataFrame, lexicon: Lexicon, name: str, tidied: str | None = None) -> DataFrame:
    """The rows with the parts of their name."""
    keep = names.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema) + ", " + _PARTS
    first = initials(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse(x, y, lexicon, first) for x, y in zip(f[name], f[tidied] if tidied else [None] * len(f))]
            parts = pd.DataFrame([(n.form, *n) for n in parsed], columns=["form", "root", "tells", "letters", "short"], index=f.index)
            yield pd.concat([f[keep], parts], axis=1)

    return names.mapInPandas(run, schema)


def grams(root: str, tells: str, letters: str, short: bool, firm: str | None = None) -> list[tuple[str, float]]:
    """Features of a name and how much they weigh before idf."""
    padded, out = f"^{root}$", {}
    for i in range(max(1, len(padded) - GRAM + 1)):
        g = padded[i : i + GRAM]
        out[g] = out.get(g, 0.0) + (SHORT_WEIGHT if short else 1.0)
    for t in tells.split():
        out[f"t:{t}"] = TELL_WEIGHT
    for c in letters[:1]:
        out[f"l:{c}"] = 1.0
    if firm:
        out[f"f:{firm}|{''.join(c for c in root if c not in 'aeiou')[:3]}"] = FIRM_WEIGHT
    return list(out.items())


def vectors(forms: DataFrame) -> DataFrame:
    """(form, gram, df, w): unit tf-idf vectors over all forms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lists = [grams(*x) for x in zip(f["root"], f["tells"], f["letters"], f["short"], f["firm"])]
            yield pd.DataFrame([(form, g, c) for form, gs in zip(f["form"], lists) for g, c in gs], columns=["form", "gram", "c"])

    every = materialize(forms.select("form", "root", "tells", "letters", "short", "firm").mapInPandas(run, "form string, gram string, c double"), "variant-grams")
    n = forms.count()
    df = every.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = every.join(df, "gram").select("form", "gram", "df", (F.col("c") * F.log(1 + F.lit(float(n)) / F.col("df"))).alias("w"))
    norm = weighted.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "form").select("form", "gram", "df", (F.col("w") / F.col("norm")).alias("w"))


def _rows_cosines(f: pd.DataFrame, t: float) -> Iterator[pd.DataFrame]:
    """Pairs of rows of one key that share a later gram too, and whose cosine from the key on is at least t."""
    n, own, size = len(f), f["w"].to_numpy(), f["codes"].map(len).to_numpy()
    key = f["key"].to_numpy()
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    row = np.repeat(np.arange(n), size)
    code, w = np.concatenate(f["codes"].to_list()), np.concatenate(f["weights"].to_list())
    order = np.lexsort((row, code, group[row]))
    row, code, w = row[order], code[order], w[order]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (group[row[1:]] != group[row[:-1]])])
    length = np.diff(np.r_[starts, len(row)])
    later = np.repeat(starts + length, length) - np.arange(len(row)) - 1  # rows after this one that have its gram
    left = np.flatnonzero(later)
    left = left[np.argsort(row[left], kind="stable")]
    met, of = np.cumsum(later[left]), row[left]
    s = 0
    while s < len(left):  # all that a row meets is summed up at once
        e = np.searchsorted(met, met[s] + MEETINGS)
        e = np.searchsorted(of, of[min(e, len(of) - 1)], "right")
        k = later[left[s:e]]
        x = np.repeat(left[s:e], k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        pair = row[x] * n + row[y]
        at = np.argsort(pair, kind="stable")
        pair, product = pair[at], (w[x] * w[y])[at]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        i, j = np.divmod(pair[first], n)
        cosine = np.add.reduceat(product, first) + own[i] * own[j]
        i, j, cosine = (z[cosine >= t] for z in (i, j, cosine))
        a, b = f.iloc[i].reset_index(drop=True), f.iloc[j].reset_index(drop=True)
        yield pd.DataFrame({"x": a["id"], "y": b["id"], "cosine": cosine, "rx": a["root"], "ry": b["root"], "few": a["few"] | b["few"]})
        s = e


def _shared(t: float):
    """The pairs of all keys of a partition that is sorted by key; whole keys are held, as few as there may be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            last = int(np.searchsorted(f["key"].to_numpy(), f["key"].iloc[-1]))
            if last or held and held[-1]["key"].iloc[-1] != f["key"].iloc[-1]:
                yield from _rows_cosines(pd.concat([*held, f.iloc[:last]], ignore_index=True), t)
                held = []
            held.append(f.iloc[last:])
        if held:
            yield from _rows_cosines(pd.concat(held, ignore_index=True), t)

    return run


def cosine_pairs(vec: DataFrame, threshold: float, long: int = 64, parts: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs of forms a < b with cosine >= threshold; no pair is lost.

    Grams are in one order, the rarest first. A form goes to each of its grams with those after it, as long as these together
    may reach the threshold. Two forms that share several grams meet at the first of them with all the others, so the whole
    cosine is summed up there; sums at later ones are smaller, and the greatest counts. What is shuffled grows as the forms do,
    not as their meetings. With parts(form, root, short) pairs whose roots are over four edits apart, which confirm() drops
    anyway, are left out on the spot. Forms that share one gram only need a product of the threshold on it: those grams are joined
    singly, as far as a form's weight reaches the threshold with the greatest weight of that gram. Forms of more than *long*
    grams are joined on single grams, all but the frequent ones whose common length is below the threshold, and multiplied out.
    """
    t = threshold - 1e-12
    ordered = vec.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "w"))).alias("v"))
    if parts is None:
        ordered = ordered.withColumns({"root": F.lit(None).cast("string"), "short": F.lit(True)})
    else:
        ordered = ordered.join(parts.select("form", "root", "short"), "form")
    ordered = materialize(ordered.withColumn("id", F.xxhash64("form")), "variant-vectors")
    short = ordered.where(F.size("v") <= long)
    coded = short.select("id", "root", F.col("short").alias("few"), F.expr("transform(v, x -> xxhash64(x.gram))").alias("c"), F.expr("transform(v, x -> x.w)").alias("ws"))
    rest = coded.select("*", F.posexplode("c").alias("i", "key")).where(F.expr(f"i < size(c) - 1 AND aggregate(slice(ws, i + 1, size(ws)), 0.0D, (s, w) -> s + w * w) >= {t * t}D"))
    rest = rest.select("key", "id", "root", "few", F.expr("ws[i]").alias("w"), F.expr("slice(c, i + 2, size(c))").alias("codes"), F.expr("slice(ws, i + 2, size(ws))").alias("weights"))
    close = rest.repartition("key").sortWithinPartitions("key").mapInPandas(_shared(t), "x bigint, y bigint, cosine double, rx string, ry string, few boolean")
    close = close.where("few OR levenshtein(rx, ry, 4) >= 0").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cosine")
    single = short.select("id", F.explode("v").alias("k")).select("id", "k.gram", "k.w").where(F.col("w") >= t)
    most = single.groupBy("gram").agg(F.max("w").alias("most"))
    single = single.join(most, "gram").where(F.col("w") * F.col("most") >= t).select("id", "gram", "w")
    strong = single.select(F.col("id").alias("x"), "gram", F.col("w").alias("wx")).join(single.select(F.col("id").alias("y"), "gram", F.col("w").alias("wy")), "gram").where("x < y").select("x", "y", (F.col("wx") * F.col("wy")).alias("cosine"))
    found = close.unionByName(strong).where(F.col("cosine") >= t).groupBy("x", "y").agg(F.max("cosine").alias("cosine"))
    prefix = F.expr(f"""aggregate(reverse(v), struct(0.0D AS tail, cast(array() AS array<string>) AS p),
        (s, x) -> struct(s.tail + x.w * x.w AS tail, IF(s.tail + x.w * x.w >= {t * t}D, array_append(s.p, x.gram), s.p) AS p)).p""")
    first = ordered.select("id", (F.size("v") > long).alias("long"), F.explode(prefix).alias("gram"))
    wide = first.where("long").select(F.col("id").alias("p"), "gram").join(first.select(F.col("id").alias("q"), "gram"), "gram").where("p <> q")
    wide = wide.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    m = ordered.select("id", F.map_from_entries(F.transform("v", lambda e: F.struct(e["gram"], e["w"]))).alias("m"))
    dot = F.expr("aggregate(map_keys(mx), 0.0D, (s, g) -> s + mx[g] * coalesce(try_element_at(my, g), 0.0D))")
    wide = wide.join(m.select(F.col("id").alias("x"), F.col("m").alias("mx")), "x").join(m.select(F.col("id").alias("y"), F.col("m").alias("my")), "y").select("x", "y", dot.alias("cosine")).where(F.col("cosine") >= t)
    named = ordered.select("id", "form")
    both = found.unionByName(wide).join(named.select(F.col("id").alias("x"), F.col("form").alias("fx")), "x").join(named.select(F.col("id").alias("y"), F.col("form").alias("fy")), "y")
    return both.select(F.least("fx", "fy").alias("a"), F.greatest("fx", "fy").alias("b"), "cosine")


def confirm(pairs: DataFrame, parts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Candidate pairs (a, b, cosine) whose parts don't contradict, with what tells short names apart."""
    first = initials(lexicon)
    cols = ["root", "tells", "letters", "short", "firm", "weight"]
    j = pairs
    for side in "ab":
        j = j.join(parts.select(F.col("form").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols]), side)

    # two edits with swaps are four without: what is further apart needn't be looked at
    j = j.where("a_short OR b_short OR levenshtein(a_root, b_root, 4) >= 0")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sides = [[Name(*x) for x in zip(*(f[f"{side}_{c}"] for c in cols[:4]))] for side in "ab"]
            ok = [same_name(x, y, p, q, first) for x, y, p, q in zip(*sides, f["a_firm"], f["b_firm"])]
            yield f[["a", "b", "cosine", "a_tells", "b_tells", "a_firm", "b_firm", "a_weight", "b_weight"]][ok]

    kept = j.mapInPandas(run, "a string, b string, cosine double, a_tells string, b_tells string, a_firm string, b_firm string, a_weight double, b_weight double")
    return materialize(kept, "variant-confirmed")


def drop_ambiguous(pairs: DataFrame) -> DataFrame:
    """Without the pairs that tie a name without telling words to several names that differ in them, but for those of its own firm."""
    tied: Column = (F.col("a_tells") == "") != (F.col("b_tells") == "")
    same_firm = F.coalesce(F.col("a_firm") == F.col("b_firm"), F.lit(False))
    side = F.when(F.col("a_tells") == "", F.col("a")).otherwise(F.col("b"))
    told = pairs.where(tied).select(side.alias("bare"), F.concat("a_tells", "b_tells").alias("told"), same_firm.alias("own"))
    vague = told.groupBy("bare").agg(F.count_distinct("told").alias("n"), F.max("own").alias("has_own")).where("n > 1")
    judged = pairs.where(tied).withColumn("own", same_firm).withColumn("bare", side).join(vague, "bare", "left")
    return pairs.where(~tied).unionByName(judged.where("n IS NULL OR (has_own AND own)").select(*pairs.columns))


def link_forms(parts: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, cut: float = CUT) -> DataFrame:
    """(node, cluster) of the forms in parts(form, root, tells, letters, short, firm, weight)."""
    pairs = confirm(cosine_pairs(vectors(parts), threshold, parts=parts), parts, lexicon)
    edges = drop_ambiguous(pairs).select("a", "b", F.col("cosine").alias("sim"), F.col("a_weight").alias("wa"), F.col("b_weight").alias("wb"))
    return average_linkage(edges, cut)


def forms_of(named: DataFrame) -> DataFrame:
    """One row a form of named(form, parts, n, firm): its rows, and the firm most of them bear."""
    firms = named.where("firm IS NOT NULL").groupBy("form", "firm").agg(F.sum("n").alias("k")).groupBy("form").agg(F.max(F.struct("k", "firm"))["firm"].alias("firm"))
    return named.groupBy("form").agg(*[F.first(c).alias(c) for c in ("root", "tells", "letters", "short")], F.sum("n").cast("double").alias("weight")).join(firms, "form", "left")


def name_clusters(rows: DataFrame, name: str, tidied: str, firm: str) -> DataFrame:
    """(name, cluster) of every distinct name that means somebody."""
    r = rows.select(F.col(name).alias("name"), F.col(tidied).alias("tidied"), F.col(firm).alias("firm")).where("name IS NOT NULL")
    by_firm = r.groupBy("name", "firm").agg(F.count(F.lit(1)).alias("n"), F.max("tidied").alias("tidied"))
    names = by_firm.groupBy("name").agg(
        F.sum("n").cast("double").alias("n"),
        F.max(F.when(F.col("firm").isNotNull(), F.struct("n", "firm")))["firm"].alias("firm"),
        F.max("tidied").alias("tidied"),
    )
    names = materialize(names, "variant-names")
    lexicon = learn(names)
    named = materialize(with_parts(names, lexicon, "name", "tidied").where("form <> ''"), "variant-parts")
    clusters = link_forms(materialize(forms_of(named), "variant-forms"), lexicon)
    return named.join(clusters, named["form"] == clusters["node"], "left").select("name", F.coalesce("cluster", "form").alias("cluster"))


def variant_pairs(rows: DataFrame, name: str, tidied: str, firm: str) -> DataFrame:
    """(name_a, name_b) of different spellings of one name, the smaller first."""
    c = materialize(name_clusters(rows, name, tidied, firm), "variant-clusters")
    a, b = c.select(F.col("name").alias("name_a"), "cluster"), c.select(F.col("name").alias("name_b"), "cluster")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
