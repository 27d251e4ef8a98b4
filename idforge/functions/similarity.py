"""Similarity of vectors and of identifier codes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def matches(a: Column, b: Column) -> Column:
    """Positions that agree, up to the shorter."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1).cast("int")


def full(a: Column, b: Column, **_) -> Column:
    """Share of positions that agree."""
    return matches(a, b) / F.size(a)


def hierarchical(a: Column, b: Column, **_) -> Column:
    """Common prefix over the length."""
    return common_prefix(a, b) / F.size(a)


def mix(a: Column, b: Column, subspaces: int = 1, **_) -> Column:
    """Common prefixes of each subspace's levels, over the length."""
    def part(x: Column, c: int) -> Column:
        return F.filter(x, lambda _, i: i % subspaces == c)

    total = F.lit(0)
    for c in range(subspaces):
        total = total + common_prefix(part(a, c), part(b, c))
    return total / F.size(a)


def hamming(a: Column, b: Column, **_) -> Column:
    """Share of equal characters of two texts, the shorter filled up with blanks."""
    n = F.greatest(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (F.substring(F.rpad(a, n, " "), i, F.lit(1)) == F.substring(F.rpad(b, n, " "), i, F.lit(1))).cast("int"))
    return F.when(n == 0, 1.0).otherwise(same / n)


def rq_weighted(a: Column, b: Column, size: int = 256, **_) -> Column:
    """1 less the weight of the first level that differs, 1 if none does."""
    i, n = common_prefix(a, b), F.size(a)
    return F.when(i >= n, 1.0).otherwise(1.0 - F.pow(F.lit(float(size)), n - i - 1) / (F.pow(F.lit(float(size)), n) - 1))


def rq_simple(a: Column, b: Column, **_) -> Column:
    return common_prefix(a, b) / F.size(a)


def code_cosine(a: Column, b: Column, **_) -> Column:
    return cosine(a, b)


def edit_share(a: Column, b: Column, **_) -> Column:
    """1 less the Levenshtein distance over the longer length; not the same as ``edit_ratio``."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / n)


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; no built-in expression has it."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Names of the similarities; own ones may be added.
SIMILARITIES: dict[str, Callable[..., Column]] = {
    "full": full, "hierarchical": hierarchical, "mix": mix, "hamming": hamming, "rq_weighted": rq_weighted,
    "rq_simple": rq_simple, "code_cosine": code_cosine, "edit_share": edit_share, "edit_ratio": lambda a, b, **_: edit_ratio(a, b),
}


def similarity(name: str) -> Callable[..., Column]:
    if name not in SIMILARITIES:
        raise ValueError(f"no similarity {name}; there are {', '.join(sorted(SIMILARITIES))}")
    return SIMILARITIES[name]
