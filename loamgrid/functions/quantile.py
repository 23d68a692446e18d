"""Weighted quantiles over bounded arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_quantile(pairs: Column, q: float) -> Column:
    """Smallest value whose cumulative weight reaches ``q`` of the total.

    ``pairs`` is ``array<struct<v double, w double>>``. Pairs with a missing value or a weight
    that is not positive are left out. The array is walked once; the cutoff is kept in the state.
    """
    good = F.filter(pairs, lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]) & (p["w"] > 0))
    s = F.array_sort(good)
    cut = F.lit(float(q)) * F.aggregate(s, F.lit(0.0), lambda a, p: a + p["w"])
    start = F.struct(F.lit(0.0).alias("cum"), cut.alias("cut"), F.lit(None).cast("double").alias("ans"))

    def step(a, p):
        cum = a["cum"] + p["w"]
        hit = F.when(cum >= a["cut"], p["v"])
        return F.struct(cum.alias("cum"), a["cut"].alias("cut"), F.coalesce(a["ans"], hit).alias("ans"))

    return F.aggregate(s, start, step, lambda a: a["ans"])
