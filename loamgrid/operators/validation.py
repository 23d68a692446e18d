"""Spatial blocks, reproducible splits and out-of-fold tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.ordering import exact_quantile_scalar, global_rank, hash_rank
from loamgrid.session import write_and_read


def blocks_equal(df: DataFrame, k: int = 5, x: str = "lon", y: str = "lat", out: str = "block") -> DataFrame:
    """Equal-width k x k blocks (k between 2 and 12)."""
    k = max(2, min(k, 12))
    b = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    d = df.withColumn("__b", b)
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(f"__b.{lo}")) / ((F.col(f"__b.{hi}") - F.col(f"__b.{lo}")) / k)), F.lit(k - 1)).cast("int")
    return d.withColumn(out, cell(y, "y0", "y1") * k + cell(x, "x0", "x1")).drop("__b")


def blocks_quantile(df: DataFrame, target: int = 25, x: str = "x", y: str = "y", out: str = "block") -> DataFrame:
    """Blocks between inner quantile edges; an edge belongs to the block above it."""
    nx = max(3, round(math.sqrt(target)))
    ny = max(3, math.ceil(target / nx))
    inner = lambda n: [i / n for i in range(1, n)]
    d = df.withColumn("__x", exact_quantile_scalar(df, x, inner(nx))).withColumn("__y", exact_quantile_scalar(df, y, inner(ny)))
    at = lambda e, v: F.size(F.filter(F.array_distinct(e), lambda q: q <= F.col(v)))
    return d.withColumn(out, at("__y", y) * nx + at("__x", x)).drop("__x", "__y")


def group_split(df: DataFrame, group: str, seeds: list[int], share: float = 0.3) -> DataFrame:
    """(seed, group, role): per seed the first ceil(share * groups) groups in hash order are test.

    Only the distinct groups are ranked; rows get their role by an equi join.
    """
    g = df.select(group).distinct()
    s = g.select(F.explode(F.array(*[F.lit(i) for i in seeds])).alias("seed"), group)
    s = s.withColumn("__h", F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.coalesce(F.col(group).cast("string"), F.lit(""))))).withColumn("__b", F.substring("__h", 1, 3))
    sizes = s.groupBy("seed", "__b").agg(F.count("*").alias("__c"))  # at most 4096 rows per seed
    before = Window.partitionBy("seed").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy("seed"))).drop("__c")
    rank = F.row_number().over(Window.partitionBy("seed", "__b").orderBy("__h", group)) + F.col("__off")
    role = F.when(rank <= F.ceil(F.lit(float(share)) * F.col("__n")), "test").otherwise("train")
    return s.join(sizes, ["seed", "__b"]).select("seed", group, role.alias("role"))


def split_rows(df: DataFrame, group: str, seeds: list[int], share: float = 0.3) -> DataFrame:
    """Every row once per seed with its role: rows multiply map-side after the small role table joins. NULL is a group."""
    roles = group_split(df, group, seeds, share).withColumnRenamed(group, "__g")
    return df.join(roles, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold): largest group to the lightest fold, equal groups by name, equal loads to the first fold.

    The driver sees how many groups have each size, no group. Of ``m`` groups of size ``n`` the greedy rule takes the
    ``m`` smallest of the loads each fold would pass through (load, load + n, ...), so a pick's place is arithmetic.
    """
    g = write_and_read(df.groupBy(group).agg(F.count("*").alias("n")), "groups")
    sizes = g.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect()  # distinct sizes, below sqrt(2 * rows)
    load, runs, done = [0] * k, [], 0
    for r in sizes:
        picks = _lightest(load, r["n"], r["m"])
        runs += [(r["n"], done, f, load[f], p, list(load)) for f, p in enumerate(picks) if p]
        done += r["m"]
        load = [x + r["n"] * p for x, p in zip(load, picks)]
    runs = df.sparkSession.createDataFrame(runs, "n bigint, done bigint, fold int, load bigint, picks bigint, loads array<bigint>")
    j = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("picks") - 1))).withColumn("at", F.col("load") + F.col("i") * F.col("n"))
    # Picks before this one: loads below, or equal at an earlier fold.
    earlier = F.transform("loads", lambda x, i: F.greatest(F.lit(0), F.ceil((F.col("at") - x + F.when(i < F.col("fold"), 1).otherwise(0)) / F.col("n"))).cast("long"))
    place = F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x) + F.col("done") + 1
    ranked = global_rank(g.withColumn("__neg", -F.col("n")), ["__neg", group], "__r")
    return ranked.join(j.select(place.alias("__r"), "fold"), "__r").select(group, "fold")


def _lightest(load: list[int], n: int, m: int) -> list[int]:
    """How many of ``m`` groups of size ``n`` each fold takes, one after another to the lightest."""
    below = lambda t: [max(0, -(-(t - x) // n)) for x in load]  # picks made at loads under t
    lo, hi = min(load), max(load) + n * m
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= m else (lo, mid - 1)
    picks = below(lo)
    for f in range(len(load)):
        if sum(picks) < m and load[f] + n * picks[f] == lo:
            picks[f] += 1
    return picks


def random_holdout(df: DataFrame, key: str, seed: int = 42, share: float = 0.3) -> DataFrame:
    """Adds role: the first ceil(share * n) rows in hash order of the key are test."""
    r = hash_rank(df, F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), [F.col(key)], "__r", "__n")
    return r.withColumn("role", F.when(F.col("__r") <= F.ceil(F.lit(float(share)) * F.col("__n")), "test").otherwise("train")).drop("__r", "__n")


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """Bucket 1..k of a row number; the first total % k buckets hold one row more."""
    big, small = F.floor(total / k) + 1, F.floor(total / k)
    cut = (total % k) * big
    return F.when(rank <= cut, F.floor((rank - 1) / big) + 1).otherwise((total % k) + F.floor((rank - 1 - cut) / F.greatest(small, F.lit(1))) + 1).cast("int")


def random_kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    r = hash_rank(df, F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), [F.col(key)], "__r", "__n")
    return r.withColumn("fold", ntile_of(F.col("__r"), F.col("__n"), k)).drop("__r", "__n")
