"""Small decision rules over columns and file tables, each with its inputs as arguments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kilometres a degree of longitude spans at the equator, and the lengths a scale bar may have.
KM_PER_DEGREE = 111.32
SCALE_BARS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)


def aspect_sincos(degrees: Column) -> tuple[Column, Column]:
    """Aspect as sine and cosine, so that 359 and 1 degrees are close."""
    a = F.radians(degrees)
    return F.sin(a), F.cos(a)


def silt(sand: Column, clay: Column) -> Column:
    """Percent that sand and clay leave; NULL if one is missing."""
    return F.lit(100.0) - sand - clay


def middle_and_range(high: Column, low: Column) -> tuple[Column, Column]:
    """Mean and span of a pair of extremes (of temperatures)."""
    return (high + low) / 2, high - low


def water_balance(rain: Column, evaporation: Column) -> Column:
    return rain - evaporation


def resolution_acceptable(offered: Column, requested: Column) -> Column:
    """Finer than or as fine as requested; without a request all are, an unknown resolution never is."""
    return requested.isNull() | F.coalesce(offered <= requested, F.lit(False))


def parent_filter_join(areas: DataFrame, requests: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """Requests with the areas of their name that lie under the requested parent; namesakes elsewhere go."""
    return areas.join(requests, [name, parent])


def role_summary(files: DataFrame, role: Column, roles: dict[str, str], can_model: Column) -> DataFrame:
    """One row: files, files of each role (``roles`` maps output names to roles) and files that may enter a model."""
    return files.agg(F.count("*").alias("files"), *[F.count_if(role == r).alias(n) for n, r in roles.items()], F.count_if(can_model).alias("can_model"))


def rows_ready(files: DataFrame, by: list[str], rows: Column, ready: Column) -> DataFrame:
    """Valid rows over the files that are ready; 0 for a group without one."""
    return files.groupBy(*by).agg(F.coalesce(F.sum(F.when(ready, rows)), F.lit(0)).alias("rows_ready"))


def status_rollup(sources: DataFrame, levels: list[str], value: Column, notable: Column) -> DataFrame:
    """Count, total and notable rows for each source, each group of them and all."""
    return sources.rollup(*levels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(notable).alias("big"))


def readiness_gate(files: DataFrame, by: list[str], sample: Column, covariate: Column, samples: int = 1, covariates: int = 1) -> DataFrame:
    """Ready with enough sample tables and enough ready covariates."""
    return files.groupBy(*by).agg(((F.count_if(sample) >= samples) & (F.count_if(covariate) >= covariates)).alias("ready"))


def preview_stride(rows: int, cols: int, most: int) -> int:
    """Smallest stride that leaves at most ``most`` cells."""
    step = max(1, math.isqrt(max(0, rows * cols - 1) // max(1, most)))
    while -(-rows // step) * -(-cols // step) > most and step < max(rows, cols):
        step += 1
    return step


def downsample_stride(cells: DataFrame, stride: int, row: str = "row", col: str = "col") -> DataFrame:
    """Every ``stride``-th cell of both directions; a filter of the scan."""
    return cells.filter((F.col(row) % stride == 0) & (F.col(col) % stride == 0))


def product_score(priority: Column, *bonuses: tuple[Column, int]) -> Column:
    """100 less the priority (99 if unknown), and each bonus whose condition holds."""
    score = F.lit(100) - F.coalesce(priority, F.lit(99))
    for holds, points in bonuses:
        score = score + F.when(holds, points).otherwise(0)
    return score


def best_product(products: DataFrame, by: list[str], score: Column, tie: str) -> DataFrame:
    """The highest score of each group, ties to the smallest ``tie``; one map-side combined aggregate."""
    b = products.groupBy(*by).agg(F.min(F.struct((-score).alias("neg"), F.col(tie).alias("tie"))).alias("b"))
    return b.select(*by, F.col("b.tie").alias(tie), (-F.col("b.neg")).alias("score"))


def binary_class_mask(value: Column, target: int) -> Column:
    """1 for the target class, 0 for others, 255 without a value."""
    return F.when(value.isNull() | F.isnan(value), 255).when(F.rint(value) == target, 1).otherwise(0)


def choose_band(bands: DataFrame, by: list[str], band: str, year: Column, wanted: int | None) -> DataFrame:
    """The first band whose year is the wanted one, else the first band."""
    miss = F.when(year == wanted, 0).otherwise(1) if wanted is not None else F.lit(1)
    best = bands.groupBy(*by).agg(F.min(F.struct(miss.alias("miss"), F.col(band).alias("band"))).alias("b"))
    return best.select(*by, F.col("b.band").alias(band))


def write_back_nodata(value: Column, valid: Column, nodata: float = -9999.0) -> Column:
    """Invalid, missing and NaN values become the nodata value."""
    return F.when(valid & value.isNotNull() & ~F.isnan(value), value).otherwise(F.lit(nodata))


def map_width_km(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Width at the mean latitude, at least 0.1 km; the cosine is held above 0.2 near the poles."""
    shrink = F.greatest(F.cos(F.radians((south + north) / 2.0)), F.lit(0.2))
    return F.greatest(F.abs(east - west) * KM_PER_DEGREE * shrink, F.lit(0.1))


def scale_bar_km(width: Column, share: float = 0.2) -> Column:
    """The longest scale bar that fills at most the share of the map's width; the shortest if none does."""
    bars = F.array(*[F.lit(b) for b in SCALE_BARS])
    return F.coalesce(F.array_max(F.filter(bars, lambda b: b <= width * share)), F.lit(SCALE_BARS[0]))
