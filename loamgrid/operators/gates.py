"""Row and column gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.operators.ordering import exact_quantile_scalar
from loamgrid.operators.schema import column_profile


def filter_valid_core(df: DataFrame, core=("lon", "lat", "som")) -> DataFrame:
    cond = None
    for c in core:
        ok = C.finite(F.col(c)).isNotNull()
        cond = ok if cond is None else cond & ok
    return df.filter(cond)


def in_lonlat_range(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def flag_outliers_3iqr(df: DataFrame, col: str, out: str = "outlier", min_valid: int = 5) -> DataFrame:
    """Marks values beyond three interquartile ranges; nothing is dropped."""
    d = df.withColumn("__q", exact_quantile_scalar(df, col, [0.25, 0.75])).withColumn("__n", df.select(F.count(col)).scalar())
    iqr = F.col("__q")[1] - F.col("__q")[0]
    far = (F.col(col) < F.col("__q")[0] - 3.0 * iqr) | (F.col(col) > F.col("__q")[1] + 3.0 * iqr)
    return d.withColumn(out, F.coalesce((F.col("__n") >= min_valid) & (iqr > 0) & far, F.lit(False))).drop("__q", "__n")


def preprocess_samples(df: DataFrame) -> DataFrame:
    """One-row report of the cleaning pass over lon, lat, som."""
    core = df.select(*[C.finite(F.col(c)).alias(c) for c in ("lon", "lat", "som")])
    good = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("som").isNotNull()
    keep = good & in_lonlat_range(F.col("lon"), F.col("lat"))
    # Rows at one place collapse before the report, so a hot place costs one row per task.
    per = core.withColumn("keep", F.coalesce(keep, F.lit(False))).groupBy("keep", "lon", "lat").agg(
        F.count("*").alias("n"), F.min("som").alias("mn"), F.max("som").alias("mx")
    )
    k = F.col("keep")
    return per.agg(
        F.sum("n").alias("rows_before"),
        F.sum(F.when(k, F.col("n")).otherwise(0)).alias("rows_after"),
        F.sum(F.when(k, F.col("n") - 1).otherwise(0)).alias("duplicate_xy"),
        F.min(F.when(k, F.col("mn"))).alias("som_min"),
        F.max(F.when(k, F.col("mx"))).alias("som_max"),
    )


def duplicate_xy_count(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    per = df.groupBy(x, y).agg(F.count("*").alias("n"))
    return per.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("rows"))


def drop_sparse_constant_features(df: DataFrame, cols: list[str], max_missing: float = 0.98) -> DataFrame:
    """(feature, keep, reason)."""
    p = column_profile(df, cols)
    rate = 1.0 - F.col("valid") / F.col("n")
    reason = F.when(rate >= max_missing, "sparse").when(F.col("constant"), "constant")
    return p.select("feature", reason.isNull().alias("keep"), F.coalesce(reason, F.lit("kept")).alias("reason"), rate.alias("missing_rate"))


def feature_quality_gate(df: DataFrame, cols: list[str], strict: bool = False, max_missing: float = 0.25, min_valid: int = 50, fallback: int = 5) -> DataFrame:
    """Keeps every feature with a value and flags weak ones; the strict form drops them.

    Where nothing is left, the least-missing few stay.
    """
    p = column_profile(df, cols).withColumn("missing_rate", 1.0 - F.col("valid") / F.col("n"))
    empty = F.col("valid") <= 0
    weak = (F.col("missing_rate") > max_missing) | (F.col("valid") < min_valid)
    gone = empty | weak if strict else empty
    p = p.withColumn("__gone", gone).withColumn("flag", ~gone & weak)
    left = p.select(F.count_if(~F.col("__gone"))).scalar()
    rows = p.select("feature", "missing_rate", "valid", "flag", "__gone")  # one row per column of the table
    least = rows.orderBy("missing_rate", "feature").limit(fallback).agg(F.collect_set("feature")).scalar()
    return rows.withColumn("keep", F.when(left > 0, ~F.col("__gone")).otherwise(F.array_contains(least, F.col("feature")))).drop("__gone")


def row_missing(cols: list[str]) -> Column:
    tot = F.lit(0)
    for c in cols:
        tot = tot + F.col(c).isNull().cast("int")
    return tot


def row_missing_gate(df: DataFrame, cols: list[str], max_rate: float = 0.5) -> DataFrame:
    n = row_missing(cols)
    return filter_valid_core(df).withColumn("missing_n", n).withColumn("missing_rate", n / len(cols)).filter(F.col("missing_rate") <= max_rate)


def core_row_gate(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    return df.filter(F.col(target).isNotNull() & (row_missing(cols) < len(cols)))


def is_categorical_layer(name: Column, distinct: Column, integral: Column) -> Column:
    return C.contains_any(F.lower(name), V.CATEGORY_WORDS) | integral | (distinct <= 20)


def temporal_compatibility(df: DataFrame, path: str, target_year: int, allow_undated: bool = True) -> DataFrame:
    """Accepts a file whose year range holds the target year, masks always, undated ones by policy."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    years = F.filter(F.transform(F.regexp_extract_all(stem, F.lit(C.YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1980, 2100))
    low = F.lower(stem)
    dyn = C.contains_any(low, V.DYNAMIC_WORDS)
    d = df.withColumn("__y", years)
    inside = (F.array_min("__y") <= target_year) & (F.array_max("__y") >= target_year)
    reason = (
        F.when(C.contains_any(low, ["clcd", "landcover_mask"]), "mask_exempt")
        .when((F.size("__y") > 0) & inside, "year_inside")
        .when(F.size("__y") > 0, "year_outside")
        .when(dyn & F.lit(not allow_undated), "dynamic_without_year")
        .when(dyn, "undated_dynamic")
        .otherwise("undated_static")
    )
    return d.withColumn("reason", reason).withColumn("accepted", ~F.col("reason").isin("year_outside", "dynamic_without_year")).drop("__y")
