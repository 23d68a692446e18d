"""Scalar building blocks as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import fixed_values as V

# Characters removed from headers, and the shape of a number.
HEADER_DROP = r"[\s_\-()（）\[\]【】{}:：/\\.%％]+"
NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
YEAR = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"


def normalize_header(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), HEADER_DROP, ""))


def normalize_name(s: str) -> str:
    """The same rule for a column name on the driver."""
    return re.sub(HEADER_DROP, "", str(s or "").strip()).lower()


def extract_numeric(c: Column) -> Column:
    """First signed decimal in the text, NULL when there is none; NaN and infinities never arise."""
    t = F.regexp_replace(c.cast("string"), "[%％]", "")
    return F.regexp_extract(t, NUMBER, 1).try_cast("double")


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def coerce_numeric(c: Column) -> Column:
    return finite(c.try_cast("double"))


def normalize_feature_name(c: Column) -> Column:
    """Drops one run of source prefixes and size or file suffixes, then all separators."""
    t = F.lower(F.trim(c))
    # Prefixes and suffixes, each removed at most once, in this order.
    for p in ("cov_domestic_local_", "cov_local_", "cov_gee_", "cov_"):
        t = F.regexp_replace(t, f"^{p}", "")
    for s in (r"_32648_250m", r"_32648_1km", r"_250m", r"_1000m", r"_1km", r"\.tif", r"\.tiff", r"\.img"):
        t = F.regexp_replace(t, f"{s}$", "")
    return F.regexp_replace(t, "[^0-9a-z一-鿿]+", "")


def mojibake_penalty(c: Column) -> Column:
    """8 per suspicious character, 2 per high Latin one, 20 per replacement character."""
    size = lambda pat: F.length(c) - F.length(F.regexp_replace(c, pat, ""))
    return size(f"[{V.MOJIBAKE}]") * 8.0 + size(r"[\u00A0-\u00FF]") * 2.0 + size(r"\uFFFD") * 20.0


def valid_year(y: Column) -> Column:
    return y.between(*V.YEAR_RANGE)


def year_from_filename(path: Column) -> Column:
    """First valid year in the base name; folders do not count."""
    base = F.element_at(F.split(path, "/"), -1)
    years = F.transform(F.regexp_extract_all(base, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.filter(years, valid_year), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def missing_reason(value: Column, nodata: Column, name: Column, masked: Column, policy: str = "never") -> Column:
    """Why a raster value is missing, NULL when it is present. Zero is a value unless the policy says otherwise."""
    if policy == "metadata":
        zero = F.lit(True)
    elif policy == "auto":
        zero = contains_any(F.lower(name), V.CATEGORY_WORDS)
    else:
        zero = F.lit(False)
    is_zero = F.coalesce(F.abs(value) <= 1e-12, F.lit(False))
    nd_zero = F.coalesce(F.abs(nodata) <= 1e-12, F.lit(False))
    at_nd = F.coalesce(~F.isnan(nodata) & (F.abs(value - nodata) <= 1e-9), F.lit(False))
    return (
        F.when(value.isNull(), "non_numeric")
        .when(masked & is_zero & ~zero, None)
        .when(masked, "masked")
        .when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), "nonfinite")
        .when(F.abs(value) >= V.EXTREME_ABS, "extreme_fill_value")
        .when(at_nd & nd_zero & ~zero, None)
        .when(at_nd, "nodata")
    )


def class_code(c: Column, codes=tuple(V.LANDCOVER)) -> Column:
    """Integer class within 1e-6 of a known code, else NULL."""
    r = F.rint(c)
    return F.when((F.abs(c - r) <= 1e-6) & r.isin([float(k) for k in codes]), r)


def dist2d(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def resolution_to_metres(rx: Column, ry: Column, lat_mid: Column, geographic: Column) -> Column:
    """Cell size in metres; degrees are scaled at the middle latitude."""
    deg = F.lit(111320.0)
    lon_m = F.abs(rx) * deg * F.greatest(F.lit(0.2), F.cos(F.radians(lat_mid)))
    return F.when(geographic, F.greatest(lon_m, F.abs(ry) * deg)).otherwise(F.greatest(F.abs(rx), F.abs(ry)))
