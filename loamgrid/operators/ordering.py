"""Exact quantiles and global row numbers that never pull all rows into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.session import write_and_read

ACCURACY = 10_000
#: With more quantiles than these of few groups the rows below brackets are counted by binary search, so many rows at once.
MANY, COUNT_ROWS = 8, 1 << 18


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] = (), out: str = "q", few: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group as an array, in two distributed passes.

    The built-in exact percentile keeps all distinct values in one buffer. Here an approximate
    sketch first brackets every wanted rank between two data values; a second pass counts the
    rows below each bracket and the distinct values inside it, and only those few are ordered.
    ``few`` says that the groups are few by construction (names of columns) and have no NULL: then the brackets go to the
    rows, and no row is sorted or shuffled to meet them.
    """
    by = list(by)
    v = F.col(value)
    src = df.select(*by, v.cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    d = 4.0 / ACCURACY
    lo = F.percentile_approx("__v", [max(0.0, p - d) for p in probs], ACCURACY)
    hi = F.percentile_approx("__v", [min(1.0, p + d) for p in probs], ACCURACY)
    sk = src.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"), lo.alias("__lo"), hi.alias("__hi"))
    small = F.col("__n") <= ACCURACY
    cuts = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(p)).alias("p"),
                F.when(small, F.col("__mn")).otherwise(F.col("__lo")[i]).alias("lo"),
                F.when(small, F.col("__mx")).otherwise(F.col("__hi")[i]).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    sk = sk.select(*by, F.col("__n"), cuts.alias("__cuts"))
    if few and len(by) == 1 and len(probs) > MANY:
        return _interpolated(_counted(src, sk, by[0], probs), by, out)
    if by:
        null_safe = None
        r = sk.select(*[F.col(b).alias(f"__k_{b}") for b in by], "__n", "__cuts")
        for b in by:
            c = src[b].eqNullSafe(r[f"__k_{b}"])
            null_safe = c if null_safe is None else null_safe & c
        j = src.join(F.broadcast(r) if few else r, null_safe)
    else:
        j = src.withColumn("__s", sk.select(F.struct("__n", "__cuts")).scalar()).select("__v", "__s.__n", "__s.__cuts")
    j = j.select(*by, "__n", "__v", F.explode("__cuts").alias("c")).filter(F.col("__v") <= F.col("c.hi"))
    # Rows below a bracket collapse into one NULL key before the shuffle.
    inside = F.when(F.col("__v") >= F.col("c.lo"), F.col("__v"))
    vc = j.groupBy(*by, "__n", F.col("c.i").alias("i"), F.col("c.p").alias("p"), inside.alias("val")).agg(F.count("*").alias("m"))
    return _interpolated(vc, by, out)


def _counted(src: DataFrame, sk: DataFrame, by: str, probs: list[float]) -> DataFrame:
    """Per group and bracket the rows below it (``val`` NULL) and the rows of each value inside it."""
    found = sk.collect()  # a row for each of the few groups
    cuts = {r[by]: tuple(np.array([c[e] for c in r["__cuts"]], np.float64) for e in ("lo", "hi")) for r in found}

    def counts(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some)
        keys, v = t.column(0).combine_chunks().dictionary_encode(), t.column(1).to_numpy()
        for code, name in enumerate(keys.dictionary.to_pylist()):
            u, m = np.unique(v[keys.indices.to_numpy() == code], return_counts=True)
            lo, hi = cuts[name]
            at = np.searchsorted(u, lo, "left")
            size = np.maximum(np.searchsorted(u, hi, "right") - at, 0)
            inside = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
            which = np.concatenate([np.arange(len(lo)), np.repeat(np.arange(len(lo)), size)])
            val = pa.array(np.concatenate([np.full(len(lo), np.nan), u[inside]]), from_pandas=True)
            rows = np.concatenate([np.append(0, np.cumsum(m))[at], m[inside]])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(which), pa.string()), pa.array(which, pa.int32()), val, pa.array(rows, pa.int64())], [by, "i", "val", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= COUNT_ROWS:
                yield from counts(some)
                some, n = [], 0
        if n:
            yield from counts(some)

    vc = src.select(by, "__v").mapInArrow(run, f"{by} string, i int, val double, m bigint").groupBy(by, "i", "val").agg(F.sum("m").alias("m"))
    sizes = src.sparkSession.createDataFrame([(r[by], r["__n"]) for r in found], f"{by} string, __n bigint")
    p = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i"))
    return vc.join(F.broadcast(sizes), by).withColumn("p", p)


def _interpolated(vc: DataFrame, by: list[str], out: str) -> DataFrame:
    """The quantiles from counts below and inside the brackets."""
    w = Window.partitionBy(*by, "i").orderBy(F.col("val").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    vc = vc.withColumn("cum", F.sum("m").over(w)).filter(F.col("val").isNotNull())
    vc = vc.withColumn("pos", F.col("p") * (F.col("__n") - 1))
    ends = vc.groupBy(*by, "i", "pos").agg(
        F.min(F.when(F.col("cum") > F.floor("pos"), F.col("val"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("pos"), F.col("val"))).alias("b"),
    )
    frac = F.col("pos") - F.floor("pos")
    val = F.when(frac == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * frac)
    res = ends.select(*by, "i", val.alias("val")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "val"))).alias("__q"))
    return res.select(*by, F.transform("__q", lambda s: s["val"]).alias(out))


def exact_quantile_scalar(df: DataFrame, value: str, probs: list[float]) -> Column:
    """The quantiles of the whole table as one array-valued scalar subquery."""
    return exact_quantiles(df, value, probs).select("q").scalar()


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__b``, the number of its range in ``order`` (NULL first), written once so that it stays.

    Spark samples the bounds, so ranges are even whatever the values' distribution; ties are split by later columns.
    """
    cut = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return write_and_read(cut.withColumn("__b", F.spark_partition_id()), "ranges")


def global_rank(df: DataFrame, order: list[str], out: str = "rank", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Row number over the whole table by ``order``, NULL first; the columns together should be unique.

    Rows are numbered inside their range and moved on by the number of rows in the ranges before
    it, so only the bounded list of range sizes is ever ordered in one place.
    """
    return _ranked(in_ranges(df, order, ranges), [F.col(o) for o in order], out, total)


def _ranked(keyed: DataFrame, order: list[Column], out: str, total: str | None) -> DataFrame:
    sizes = keyed.groupBy("__b").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offs = sizes.select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    res = keyed.join(offs, "__b").withColumn(out, F.row_number().over(Window.partitionBy("__b").orderBy(*order)) + F.col("__off"))
    if total:
        res = res.withColumn(total, sizes.select(F.sum("__c")).scalar())
    return res.drop("__b", "__off")


def hash_rank(df: DataFrame, text: Column, tie: list[Column] = (), out: str = "rank", total: str | None = None) -> DataFrame:
    """Row number in md5 order of ``text``: a reproducible shuffle; 4096 hash-prefix buckets."""
    h = df.withColumn("__h", F.md5(text)).withColumn("__b", F.substring("__h", 1, 3))
    return _ranked(h, [F.col("__h"), *tie], out, total).drop("__h")


def running(df: DataFrame, by: list[str], order: list[str], value: Column, how: str = "sum", out: str = "running", ranges: int | None = None) -> DataFrame:
    """Running sum or maximum per group in ``order``, split so that a hot group spreads over tasks.

    Rows are cut into even ranges of (group, order). Each range is scanned on its own; what the
    ranges before it hold of the same group comes from one aggregate row per group and range.
    NULL groups are a group, NULL order keys come first.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    d = in_ranges(df.withColumn("__v", value), [*by, *order], ranges)
    tot = d.groupBy(*by, "__b").agg(agg("__v").alias("__t"))
    prev = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ranges a group reaches
    tot = tot.select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__b").alias("__c"), agg("__t").over(prev).alias("__before"))
    w = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__b") == F.col("__c")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    j = d.withColumn("__i", agg("__v").over(w)).join(tot, same)
    both = F.coalesce(F.col("__before") + F.col("__i"), F.col("__before"), F.col("__i")) if how == "sum" else F.greatest("__before", "__i")
    return j.select(*df.columns, both.alias(out))
