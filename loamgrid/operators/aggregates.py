"""Audits, metrics and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.operators.ordering import exact_quantiles
from loamgrid.operators.schema import column_profile, unpivot

#: Rows that are multiplied at a time.
PAIR_ROWS = 4096


def feature_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: counts, rates, distinct values, range, mean, sample deviation, near-constant."""
    a = column_profile(df, cols, distinct=True)
    return a.select(
        "feature", "n", "valid",
        (F.col("n") - F.col("valid")).alias("missing"),
        (1.0 - F.col("valid") / F.col("n")).alias("missing_rate"),
        "zeros", (F.col("zeros") / F.col("n")).alias("zero_rate"), F.col("distinct").alias("n_distinct"),
        F.col("min").alias("mn"), F.col("max").alias("mx"), "mean", "std",
        (F.col("constant") | (F.coalesce("std", F.lit(0.0)) < 1e-12)).alias("near_constant"),
    )


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per pair of columns (i < j, by place in ``cols``) over the rows that hold both: n, r; NULL r for a constant one.

    One Arrow pass: every task sums the products of its rows by matrix multiplication into five matrices of the columns'
    size and returns a row per pair, so what is shuffled depends on tasks and columns only. Values are taken
    less their column's mean (first pass), which keeps the sums exact enough for large offsets. NaN and infinities
    count as missing.
    """
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    x = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c)
    mean = list(x.agg(*[one(c) for c in x.columns]).first()) if cols else []
    centre = np.array([m if m is not None else 0.0 for m in mean])
    k = len(cols)
    at = np.triu_indices(k, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((6, k, k))
        for b in batches:
            for s in range(0, b.num_rows, PAIR_ROWS):
                part = b.slice(s, PAIR_ROWS)
                v = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float) - centre
                has = ~np.isnan(v)
                v, m = np.where(has, v, 0.0), has.astype(float)
                for a, (left, right) in zip(acc, ((m, m), (v, m), (m, v), (v * v, m), (m, v * v), (v, v))):
                    a += left.T @ right
        if acc[0].any():
            names = ("n", "sa", "sb", "saa", "sbb", "sab")
            cells = {"i": pa.array(at[0], pa.int32()), "j": pa.array(at[1], pa.int32())} | {n: pa.array(a[at]) for n, a in zip(names, acc)}
            yield pa.RecordBatch.from_pydict(cells)

    if k < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, n long, r double")
    t = x.mapInArrow(sums, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    t = t.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    varies = (spread("sa", "saa") > 1e-12 * F.col("saa")) & (spread("sb", "sbb") > 1e-12 * F.col("sbb"))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.sqrt(spread("sa", "saa")) * F.sqrt(spread("sb", "sbb")))
    r = F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return t.filter("n > 0").select("i", "j", F.col("n").cast("long").alias("n"), r.alias("r"))


def high_corr_pairs(df: DataFrame, cols: list[str], least: float = 0.98) -> DataFrame:
    """Pairs of features with |r| at or above the limit, over the rows that hold both (``pair_moments``)."""
    names = F.array(*[F.lit(c) for c in cols])
    p = pair_moments(df, cols).filter(F.abs("r") >= least)
    return p.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "r")


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "pred", by: list[str] = (), medae: bool = False) -> DataFrame:
    """n, r2 (NULL below two distinct targets), rmse, mae, bias; median absolute error on request."""
    by = list(by)
    e = F.col(p) - F.col(y)
    ok = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    m = ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(e * e).alias("__sse"),
        (F.var_pop(y) * F.count("*")).alias("__sst"),
        F.min(y).alias("__a"),
        F.max(y).alias("__b"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
    )
    m = m.select(
        *by, "n",
        F.when(F.col("__b") > F.col("__a"), 1.0 - F.col("__sse") / F.col("__sst")).alias("r2"),
        F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"), "mae", "bias",
    )
    if not medae:
        return m
    q = exact_quantiles(ok.select(*by, F.abs(e).alias("__e")), "__e", [0.5], by, out="__q")
    m = m.join(q, by) if by else m.withColumn("__q", q.select("__q").scalar())
    return m.withColumn("medae", F.col("__q")[0]).drop("__q")


def aoi_subset_metrics(df: DataFrame, inside: Column, min_rows: int = 8) -> DataFrame:
    """Metrics over the rows inside the area, and their share; NULL metrics for too few rows."""
    tot = df.select(F.count("*")).scalar()
    m = regression_metrics(df.filter(inside))
    ok = (F.col("n") >= min_rows) & F.col("r2").isNotNull()
    return m.select("n", (F.col("n") / tot).alias("share"), *[F.when(ok, F.col(c)).alias(c) for c in ("r2", "rmse", "mae", "bias")])


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the metrics over folds."""
    cols = ("r2", "rmse", "mae", "bias")
    return folds.agg(F.count("*").alias("folds"), *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def impute_median_mode(df: DataFrame, continuous: list[str], coded: list[str]) -> DataFrame:
    """Median (0 when none) for continuous columns, most frequent value (smallest on a tie) for codes."""
    med = exact_quantiles(unpivot(df, continuous), "value", [0.5], ["feature"], few=True) if continuous else None
    out = df
    if med is not None:
        m = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("q")[0])))).scalar()  # one entry per column
        out = out.withColumn("__m", m)
        out = out.select(*[F.coalesce(F.col(c).cast("double"), F.col("__m")[c], F.lit(0.0)).alias(c) if c in continuous else F.col(c) for c in df.columns])
    for c in coded:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), c)))
        mode = top.select(F.col(top.columns[0])[c]).scalar()
        out = out.withColumn(c, F.coalesce(c, mode))
    return out


def dominant(df: DataFrame, key: str, missing: str = "unmatched") -> DataFrame:
    """One row: leading class, its count, all rows, ratio."""
    c = df.groupBy(F.coalesce(key, F.lit(missing)).alias("name")).agg(F.count("*").alias("n"))
    r = c.agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "name")).alias("b"))
    return r.select("b.name", (-F.col("b.k")).alias("n"), "total", (-F.col("b.k") / F.col("total")).alias("ratio"))


def dominant_year(df: DataFrame, text: Column, least: float = 0.8) -> DataFrame:
    """Leading valid year in a text column, when it reaches the share."""
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(*V.YEAR_RANGE))
    y = df.select(F.get(years, F.lit(0)).alias("year"))
    c = y.groupBy("year").agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n").alias("total"), F.min(F.when(F.col("year").isNotNull(), F.struct((-F.col("n")).alias("k"), "year"))).alias("b"))
    ratio = -F.col("b.k") / F.col("total")
    return tot.select(F.when(ratio >= least, F.col("b.year")).alias("year"), ratio.alias("ratio"))


def coarsest_resolution(evidence: DataFrame, level: Column, user: Column | None = None) -> DataFrame:
    """Chosen cell size per group: user value, else the coarsest evidence; when all is fine, the level default."""
    default = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in V.LEVEL_RESOLUTION.items()], F.lit(V.LEVEL_RESOLUTION["city"]))
    top = F.col("coarsest")
    auto = F.when(top.isNull() | (top <= V.FINE_LIMIT_M), default).otherwise(F.greatest(F.lit(1.0), F.rint(top)))
    return evidence.withColumn("resolution", F.coalesce(user, auto) if user is not None else auto)


def oof_average(preds: DataFrame, key: str, fold: str, mean: list[str], first: list[str]) -> DataFrame:
    """One row per sample from repeated predictions: mean of the numbers, first fold's value of the rest."""
    f = F.min(F.struct(fold, *first))
    return preds.groupBy(key).agg(*[F.avg(c).alias(c) for c in mean], f.alias("__f")).select(key, *mean, *[F.col(f"__f.{c}").alias(c) for c in first])


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive hash sum over all columns: one partial aggregate, no sort."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("content"))


def thin_every_nth(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row of the global order."""
    from loamgrid.operators.ordering import global_rank

    r = global_rank(df, order, "__r", "__n")
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return r.filter((F.col("__r") - 1) % step == 0).drop("__r", "__n")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Order-preserving de-duplication: the smallest row per key, combined map-side."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__f")).select(*key, "__f.*").select(*df.columns)


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Last n rows per group; the limit is applied before the shuffle by the group-limit rule."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
