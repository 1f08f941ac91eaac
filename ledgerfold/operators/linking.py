"""Owner names linked to a register in stages: override, exact, normalised, fuzzy; every stage sees what the ones before left.

The fuzzy stage compares the words in order of the alphabet. Two such strings of a ratio of at least r differ by k edits at most,
and k edits change 3 * k runs of three letters; so, with the runs of each string from the rarest to the most frequent, the two
share one among their first 3 * k + 1, and only names that do meet (strings that mostly repeat one run excepted). Frequent runs
come last and are hardly ever asked for. No stage compares all names with all.

Defined results: null and empty names stay unlinked; of several register entries of one form the smallest id counts;
repeated names are linked once; an empty register links nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms that a normalised name is stripped of at its end, and Japanese ones at either end.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh", "ag", "sa", "nv", "bv", "ab", "kk", "kabushiki kaisha", "group", "holdings")
JAPANESE = ("株式会社", "有限会社")
PASSES = 4


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


#: Unicode compatibility form; the engine has no function for it.
nfkc = F.pandas_udf(_nfkc, StringType())


def company_key(name: Column, compatibility: bool = True) -> Column:
    """A company name in lower case, `&` as and, without a leading `the`, punctuation and legal forms (up to four at its end)."""
    c = F.lower(nfkc(name) if compatibility else name)
    for j in JAPANESE:
        c = F.replace(c, F.lit(j), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(c, "&", " and "), "[.,'()/-]+", " ")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, " +", " ")), "^the ", "")
    for _ in range(PASSES):
        c = F.trim(F.regexp_replace(c, f" ({'|'.join(SUFFIXES)})$", ""))
    return c


def in_order(key: Column) -> Column:
    """The words of a key in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def _runs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def _first_runs(rows: DataFrame, frequency: DataFrame, least: Column) -> DataFrame:
    """rows(text, ...) once for each of the rarest runs of its text that a string of at least the ratio must share one of."""
    spread = rows.withColumn("run", F.explode(_runs(F.col("text")))).join(frequency, "run", "left")
    k = F.floor((1 - least) * F.length("text") / least + 1e-9).cast("int")
    kept = spread.groupBy(*rows.columns).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))).alias("runs"))
    return kept.withColumn("run", F.explode(F.slice("runs", F.lit(1), 3 * k + 1)["run"])).drop("runs")


def ratio(x: Column, y: Column) -> Column:
    """1 - edit distance / greater length."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest > 0, 1 - F.levenshtein(x, y) / longest).otherwise(F.lit(0.0))


def link_names(names: DataFrame, name: str, register: DataFrame, entity: str, registered: str, overrides: dict[str, str] | None = None, least: float = 0.84, short: float = 0.95, compatibility: bool = True) -> DataFrame:
    """(name, entity, level, ratio) of every distinct name; level is override, exact, normalised, fuzzy or none."""
    n = names.select(F.col(name).alias("name")).where("name IS NOT NULL AND trim(name) <> ''").distinct().withColumn("key", company_key(F.col("name"), compatibility))
    r = register.select(F.col(entity).alias("entity"), F.col(registered).alias("registered")).where("entity IS NOT NULL AND registered IS NOT NULL")
    by_name = r.groupBy(F.col("registered").alias("name")).agg(F.min("entity").alias("e_exact"))
    by_key = r.withColumn("key", company_key(F.col("registered"), compatibility)).where("key <> ''").groupBy("key").agg(F.min("entity").alias("e_key"))
    given = names.sparkSession.createDataFrame(list((overrides or {}).items()), "name string, e_given string")
    staged = n.join(given, "name", "left").join(by_name, "name", "left").join(by_key, "key", "left")
    done = F.coalesce("e_given", "e_exact", "e_key")
    level = F.when(F.col("e_given").isNotNull(), "override").when(F.col("e_exact").isNotNull(), "exact").when(F.col("e_key").isNotNull(), "normalised")
    linked = staged.where(done.isNotNull()).select("name", done.alias("entity"), level.alias("level"), F.lit(1.0).alias("ratio"))
    limit = F.when(F.length("own") < 6, short).otherwise(least)
    left = staged.where(done.isNull() & (F.col("key") != "")).select("name", F.col("key").alias("own"), in_order(F.col("key")).alias("text"))
    known = by_key.select("e_key", in_order(F.col("key")).alias("text")).groupBy("text").agg(F.min("e_key").alias("e_key"))
    frequency = known.select(F.explode(_runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    a = _first_runs(left, frequency, limit)
    b = _first_runs(known, frequency, F.lit(least)).withColumnRenamed("text", "other")
    met = a.join(b, "run").select("name", "own", "text", "other", "e_key").distinct()
    met = met.where(F.abs(F.length("text") - F.length("other")) <= (1 - least) * F.greatest(F.length("text"), F.length("other")))
    met = met.withColumn("ratio", F.round(ratio(F.col("text"), F.col("other")), 6))
    close = met.where(F.col("ratio") >= limit)
    w = Window.partitionBy("name").orderBy(F.desc("ratio"), "e_key")
    fuzzy = close.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", F.col("e_key").alias("entity"), F.lit("fuzzy").alias("level"), "ratio")
    rest = staged.where(done.isNull()).select("name").join(fuzzy.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("entity"), F.lit("none").alias("level"), F.lit(0.0).alias("ratio"))
    return linked.unionByName(fuzzy).unionByName(rest)


def clean_unicode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All text columns of a result in Unicode compatibility form."""
    for f in frames:
        for c in f.columns[f.dtypes == object]:
            f[c] = f[c].map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)
        yield f
