"""Ranking metrics over an array of predictions and an array of relevant ids.

Predictions may repeat and be fewer than k. Repeats count as the metrics'
original definitions have it; ``distinct`` in ``evaluate`` removes them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20, 50, 100)


def _top(p: Column, k: int) -> Column:
    return F.slice(p, 1, k)


def recall(t: Column, p: Column, k: int) -> Column:
    """Entries of the top k that are relevant, over all relevant."""
    hits = F.size(F.filter(_top(p, k), lambda x: F.array_contains(t, x)))
    return F.when(F.size(t) == 0, 0.0).otherwise(hits / F.size(t))


def hit(t: Column, p: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(t, _top(p, k)), F.lit(False)).cast("double")


def precision(t: Column, p: Column, k: int) -> Column:
    """Distinct hits over the length of the (possibly shorter) top k."""
    return F.size(F.array_intersect(t, _top(p, k))) / F.greatest(F.lit(1), F.size(_top(p, k)))


def reciprocal_rank(t: Column, p: Column, k: int | None = None) -> Column:
    top = p if k is None else _top(p, k)
    at = F.array_position(F.transform(top, lambda x: F.array_contains(t, x)), True)
    return F.when(F.coalesce(at, F.lit(0)) == 0, 0.0).otherwise(1.0 / at)


def ndcg(t: Column, p: Column, k: int) -> Column:
    """Gains 1 / log2(rank + 1) over those of all relevant ids first, the latter at least 0.3."""
    gain = F.aggregate(F.transform(_top(p, k), lambda x, i: F.when(F.array_contains(t, x), 1.0 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), lambda i: 1.0 / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(t) == 0, 0.0).otherwise(gain / F.greatest(F.lit(0.3), ideal))


def average_precision(t: Column, p: Column, k: int = 20) -> Column:
    """Precision at each first hit in the top k, over all relevant (at least one)."""
    top = _top(p, k)
    first = F.transform(top, lambda x, i: F.when(F.array_contains(t, x) & (F.array_position(top, x) == i + 1), i + 1).otherwise(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    total = F.aggregate(first, start, lambda a, r: F.struct((a["n"] + (r > 0).cast("int")).alias("n"), (a["s"] + F.when(r > 0, (a["n"] + 1) / r).otherwise(0.0)).alias("s")), lambda a: a["s"])
    return total / F.greatest(F.lit(1), F.size(t))


def exact_match(p: Column, t: Column) -> Column:
    """1 where the first prediction is the (first) target, 0 where it isn't or there is none."""
    return F.coalesce((F.get(p, F.lit(0)) == F.get(t, F.lit(0))).cast("double"), F.lit(0.0))


def all_metrics(t: Column, p: Column) -> dict[str, Column]:
    """The twenty metrics by name."""
    out = {"mrr": reciprocal_rank(t, p), "mrr_10": reciprocal_rank(t, p, 10), "mrr_100": reciprocal_rank(t, p, 100), "map_20": average_precision(t, p), "ndcg_10": ndcg(t, p, 10), "ndcg_20": ndcg(t, p, 20), "ndcg_100": ndcg(t, p, 100)}
    out |= {f"p_{k}": precision(t, p, k) for k in (1, 10, 20, 100)}
    out |= {f"r_{k}": recall(t, p, k) for k in (1, 5, 10, 100, 1000)}
    return out | {f"hit_{k}": hit(t, p, k) for k in (1, 5, 10, 100)}


def evaluate(ranked: DataFrame, distinct: bool = False) -> DataFrame:
    """Metrics of each query: ``qid`` and the twenty, from ``qid``, ``truth``, ``pred``."""
    p = F.array_distinct("pred") if distinct else F.col("pred")
    t = F.array_distinct("truth")
    return ranked.select("qid", *(c.alias(n) for n, c in all_metrics(t, p).items()))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row with the mean of every metric and the number of queries."""
    names = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("queries"))
