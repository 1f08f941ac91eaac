"""Column functions: vectors, scores, finance, text. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def inverse_distance(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


#: Fixed values of the fit score.
FIT_ALPHA, FIT_BETA = -4.0, (6.0, 3.0, 2.0, 1.0)


def fit_score(cos: Column, inverse: Column, classes: Column, cites: Column | None = None) -> Column:
    """Logistic score of a firm for a cluster, 0 where the gate is closed."""
    cite = cites if cites is not None else F.lit(0.0)
    gate = (classes > 0.01) | (cite > 0) | (cos > 0.3)
    x = F.lit(FIT_ALPHA) + FIT_BETA[0] * cos + FIT_BETA[1] * inverse + FIT_BETA[2] * classes + FIT_BETA[3] * cite
    return F.when(gate, 1 / (1 + F.exp(-x))).otherwise(F.lit(0.0))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def black_scholes_call(s: Column, k: Column, years: Column, rate: float, sigma: Column) -> Column:
    d1 = (F.log(s / k) + (F.lit(rate) + sigma * sigma / 2) * years) / (sigma * F.sqrt(years))
    d2 = d1 - sigma * F.sqrt(years)
    return s * normal_cdf(d1) - k * F.exp(-F.lit(rate) * years) * normal_cdf(d2)


def int_date(col: Column) -> Column:
    """YYYYMMDD integers to dates; 0 and null are unknown."""
    return F.when(col > 0, F.try_to_date(col.cast("string"), "yyyyMMdd"))


def token_sort(name: Column) -> Column:
    """Words of a name in order of the alphabet, lower case, without punctuation."""
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length, of whole strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))
