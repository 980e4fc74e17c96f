"""Hotness of an item from the ranks it held."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hotness(ranks: Column, count: Column | None = None, threshold: int = 5, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Weighted sum of mean rank score, frequency and share of high ranks; 0 without ranks."""
    n = F.size(ranks)
    times = F.coalesce(count, n) if count is not None else n
    score = F.aggregate(ranks, F.lit(0).cast("long"), lambda s, r: s + 11 - F.least(r, F.lit(10)))
    high = F.size(F.filter(ranks, lambda r: r <= threshold))
    by_rank, by_times, by_high = weights
    value = by_rank * (score * 10 / n) + by_times * (F.least(times, F.lit(10)) * 10) + by_high * (high * 100 / n)
    return F.when(n > 0, value).otherwise(F.lit(0.0))


def hotness_of_group(rank: str, threshold: int = 5, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """The same as an aggregate over rows with one rank each; combines on the map side."""
    r = F.col(rank)
    n = F.count(r)
    by_rank, by_times, by_high = weights
    return (
        by_rank * F.avg(11 - F.least(r, F.lit(10))) * 10
        + by_times * F.least(n, F.lit(10)) * 10
        + by_high * F.avg((r <= threshold).cast("int")) * 100
    )
