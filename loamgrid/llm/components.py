"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.tables import settle


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each pair with the least neighbour of u, u itself included. Minima are combined map-side."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of every linked node. Runs until nothing changes."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    stars = settle(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "stars")
    state = None
    while True:
        sign = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == state:
            break
        state = sign
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u and v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        near = _toward_least(large)
        small = near.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(near.select("u", F.col("least").alias("v"))).distinct()
        stars = settle(small, "stars")
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
