"""Ranked text search: BM25 over words, as plain aggregates; queries made safe, and their variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.columns import cosine
from ledgerfold.operators.similar import centroids

#: Operators that are no words of a query, and words too common to search for.
OPERATORS = {"and", "or", "not", "near"}
STOP = {"a", "an", "the", "of", "for", "with", "and", "or", "to", "in", "on", "by", "is", "are", "using"}


def sanitise(query: str) -> list[str] | None:
    """The words of a query that can be searched for: three letters or more, no operators, no symbols; None if none is left."""
    words = [re.sub(r"[^\w-]", "", w).lower() for w in query.split() if w.lower() not in OPERATORS]
    return [w for w in words if len(w) >= 3] or None


def variants(query: str) -> list[tuple[str, list[str]]]:
    """Ways to ask, the strictest first: ('all', words), ('any', up to six), ('one', a long word) ...; Japanese by pieces."""
    words = sanitise(query) or []
    if query and sum(c > "⺀" for c in query) > len(query) / 3:
        pieces = [p for p in re.split(r"[\s、。・のをにはがとで]+", query) if len(p) > 1][:5]
        return [("all", [query.strip()]), ("any", pieces)]
    content = [w for w in words if w not in STOP]
    return [("all", words), ("any", content[:6]), *[("one", [w]) for w in content if len(w) > 4]] if words else []


def matches(text: Column, how: str, words: list[str]) -> Column:
    """Whether the text holds all, or any, of the words as substrings; nothing matches no words."""
    if not words:
        return F.lit(False)
    hits = [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower())) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if how == "all" else (out | h)
    return out


def search_variants(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """(key, how, step) of what the first variant of the query that hits anything finds; one scan for all variants."""
    ways = variants(query)
    if not ways:
        return docs.select(key, F.lit("").alias("how"), F.lit(0).alias("step")).limit(0)
    step = F.lit(None).cast("int")
    for i, (how, words) in reversed(list(enumerate(ways))):
        step = F.when(matches(text, how, words), i).otherwise(step)
    found = docs.select(key, step.alias("step")).where("step IS NOT NULL").groupBy(key).agg(F.min("step").alias("step"))
    first = found.agg(F.min("step").alias("first"))  # one row
    names = F.create_map(*[x for i, (how, _) in enumerate(ways) for x in (F.lit(i), F.lit(how))])
    return found.join(F.broadcast(first), F.col("step") == F.col("first")).select(key, F.element_at(names, F.col("step")).alias("how"), "step")


def _is(value: int):
    return lambda x: x == value


def bm25(docs: DataFrame, doc_id: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with any of the words; statistics over all documents, the query is a literal list.

    A document is split once; what is joined with the statistics is its length and its counts.
    """
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    index = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    counts = docs.select(F.col(doc_id).alias("doc_id"), split.alias("w")).select("doc_id", F.size("w").alias("len"), F.filter(F.transform("w", lambda x: F.try_element_at(index, x)), lambda i: i.isNotNull()).alias("hits"))
    counts = counts.select("doc_id", "len", *[F.size(F.filter("hits", _is(i))).alias(f"tf_{i}") for i in range(len(words))])
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf_{i}") > 0).cast("int")).alias(f"df_{i}") for i in range(len(words))])
    j = counts.where(" OR ".join(f"tf_{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))  # statistics: one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return j.select("doc_id", F.round(score, 6).alias("score"))


def text_vector(ranked: DataFrame, vectors: DataFrame, key: str, vector: str, most: int = 200) -> DataFrame:
    """(centre, n, confidence): the mean vector of the best *most* hits ranked(key, rank), weighing 1 / rank; none of fewer than three."""
    top = ranked.where(F.col("rank") <= most).join(vectors.select(key, F.col(vector).alias("v")).where("v IS NOT NULL"), key)
    w = top.select(F.lit(1).alias("one"), "v", (1 / F.col("rank")).alias("w"))
    return centroids(w, "one", "v", "w").where("n >= 3").select("centre", "n", F.least(F.lit(1.0), F.col("n") / 20).alias("confidence"))


def vector_clusters(centre: DataFrame, clusters: DataFrame, group: str, k: int, least: float = 0.0, without: str | None = None) -> DataFrame:
    """(group, similarity) of the k clusters(group, centre) nearest to one vector, of at least *least*, outside a section."""
    one = F.broadcast(centre.select(F.col("centre").alias("own")))  # one row
    scored = clusters.select(group, "centre").join(one).select(group, F.round(cosine(F.col("own"), F.col("centre")), 6).alias("similarity")).where(F.col("similarity") >= least)
    if without:
        scored = scored.orderBy(F.desc("similarity"), group).limit(3 * k).where(~F.startswith(F.col(group).cast("string"), F.lit(without)))
    return scored.orderBy(F.desc("similarity"), group).limit(k)
