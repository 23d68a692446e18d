"""Request, file-name and chat text as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions import fixed_values as V

# Patterns of the request grammar.
YEAR_TOKEN = r"(?<!\d)((?:19|20)\d{2,3})"
RES_NEAR_KM = r"(?i)(?:分辨率|像元大小|空间分辨率|resolution)[^0-9]{0,12}(\d+(?:\.\d+)?)\s*(?:公里|千米|km)"
RES_NEAR_M = r"(?i)(?:分辨率|像元大小|空间分辨率|resolution)[^0-9]{0,12}(\d+(?:\.\d+)?)\s*(?:米|m)"
RES_KM = r"(?i)(\d+(?:\.\d+)?)\s*(?:公里|千米|km)"
RES_M = r"(?i)(\d+(?:\.\d+)?)\s*(?:米|m)"
CRS_CODE = r"(?i)EPSG\s*[:：]?\s*(\d{4,6})"
CRS_NEAR = r"(?i)(?:坐标系|投影|crs)[^0-9A-Za-z]{0,10}(\d{4,6})"
REF_FILE = [
    r"(?i)以\s*([^，。；;\n]+?\.(?:tif|tiff|img|vrt))\s*为基准",
    r"(?i)对齐到\s*([^，。；;\n]+?\.(?:tif|tiff|img|vrt))",
    r"(?i)参照\s*([^，。；;\n]+?\.(?:tif|tiff|img|vrt))",
    r"(?i)基准(?:图层|栅格|文件)?\s*(?:为|是|:|：)?\s*([^，。；;\n]+?\.(?:tif|tiff|img|vrt))",
]
REF_SHORT = ["DEM", "BD", "CEC", "pH", "LULC", "CLCD"]
PLACE = "([一-龥]{2,12}(?:" + "|".join(V.REGION_SUFFIXES) + "))"
PLACE_TRIM = "^[年在于为给下载获取准备我]+"


def _grab(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def let(value: Column, use) -> Column:
    """Binds an expression, so that a lambda or branches that read it often evaluate it once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_alias(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Name of the first listed alias contained in the text; one literal array keeps the expression small."""
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in pairs])
    return let(text, lambda t: F.get(F.filter(arr, lambda x: F.contains(t, x["a"])), F.lit(0))["n"])


def parse_year(c: Column) -> Column:
    """Four digits as they are; a five-digit slip such as 20220 means first two and last two."""
    raw = _grab(c, YEAR_TOKEN)
    slip = F.concat(F.substring(raw, 1, 2), F.substring(raw, 4, 2)).try_cast("int")
    plain = F.substring(raw, 1, 4).try_cast("int")
    fixed = F.when(slip.between(*V.YEAR_RANGE), slip).otherwise(plain)
    return F.when(F.length(raw) == 4, plain).when(raw.startswith("20"), fixed)


def parse_resolution(c: Column) -> Column:
    """Metres from the value next to a keyword, else from any value with a unit."""
    m = lambda pat, k: _grab(c, pat).try_cast("double") * F.lit(float(k))
    ok = lambda v: F.when((v > 0) & (v <= 1_000_000), v)
    return F.coalesce(*[ok(m(p, k)) for p, k in ((RES_NEAR_KM, 1000), (RES_NEAR_M, 1), (RES_KM, 1000), (RES_M, 1))])


def finest_resolution(c: Column) -> Column:
    """The smallest of all values with a unit."""
    vals = lambda pat, k: F.transform(F.regexp_extract_all(c, F.lit(pat), F.lit(1)), lambda v: v.try_cast("double") * F.lit(float(k)))
    both = F.concat(vals(RES_KM, 1000), vals(RES_M, 1))
    return F.array_min(F.filter(both, lambda v: (v > 0) & (v <= 100_000)))


def parse_crs(c: Column) -> Column:
    """EPSG code, a number next to a keyword, then the longest alias."""
    compact = F.regexp_replace(F.lower(c), r"[\s_\-]+", "")
    alias = _first_alias(compact, sorted(V.CRS_ALIASES.items(), key=lambda p: (-len(p[0]), p[0])))
    return F.coalesce(F.concat(F.lit("EPSG:"), _grab(c, CRS_CODE)), F.concat(F.lit("EPSG:"), _grab(c, CRS_NEAR)), alias)


def parse_reference_name(c: Column) -> Column:
    """File after a reference phrase, else a short layer name in one."""
    files = [F.element_at(F.split(F.trim(_grab(c, p)), "/"), -1) for p in REF_FILE]
    short = [F.when(c.rlike(rf"(?i)以\s*{k}\s*为基准"), F.lit(k)) for k in REF_SHORT]
    return F.coalesce(*files, *short)


def parse_region(c: Column) -> Column:
    """Place after the year, after a verb, else the longest candidate."""
    clean = lambda v: F.nullif(F.regexp_replace(v, PLACE_TRIM, ""), F.lit(""))
    after_year = clean(_grab(c, "(?:19|20)\\d{2}年?" + PLACE))
    after_verb = clean(_grab(c, "(?:下载|获取|准备|寻找|查找)" + PLACE))
    cands = F.transform(F.regexp_extract_all(c, F.lit(PLACE), F.lit(1)), lambda v: F.regexp_replace(v, PLACE_TRIM, ""))
    ranked = F.array_sort(F.transform(F.filter(cands, lambda v: F.length(v) > 1), lambda v: F.struct((-F.length(v)).alias("k"), v.alias("v"))))
    return F.coalesce(after_year, after_verb, F.get(ranked, F.lit(0))["v"])


# Names, phrases and limits of the model parameters.
MODEL_PARAMS = {
    "n_estimators": (r"(?i)(?:n_estimators|树数|树的数量|RF树数)\s*[=:：为]*\s*(\d+)", 50, 3000),
    "max_depth": (r"(?i)(?:max_depth|最大深度|树深度|深度)\s*[=:：为]*\s*(\d+)", 2, 80),
    "min_samples_leaf": (r"(?i)(?:min_samples_leaf|最小叶节点样本|叶节点最小样本|叶子最小样本|叶样本)\s*[=:：为]*\s*(\d+)", 1, 50),
    "min_samples_split": (r"(?i)(?:min_samples_split|最小分裂样本|分裂最小样本)\s*[=:：为]*\s*(\d+)", 2, 100),
    "max_features": (r"(?i)(?:max_features|最大特征比例|特征比例|特征抽样比例)\s*[=:：为]*\s*([0-9]*\.?[0-9]+)", 0.1, 1.0),
    "nlags": (r"(?i)(?:nlags|变差函数分组数|滞后组数|半方差分组数)\s*[=:：为]*\s*(\d+)", 4, 30),
}
VARIOGRAM_WORD = r"(?i)(?:variogram_model|变差函数|半方差模型)\s*[=:：为]*\s*(spherical|exponential|gaussian|linear|power)"


def parse_model_params(c: Column) -> Column:
    """Struct of the named parameters, each clamped to its limits, NULL when absent."""
    f = [
        F.least(F.greatest(_grab(c, p).try_cast("double"), F.when(_grab(c, p).isNotNull(), F.lit(float(lo)))), F.when(_grab(c, p).isNotNull(), F.lit(float(hi)))).alias(k)
        for k, (p, lo, hi) in MODEL_PARAMS.items()
    ]
    return F.struct(*f, F.lower(_grab(c, VARIOGRAM_WORD)).alias("variogram_model"))


def parse_landcover_scope(c: Column) -> Column:
    """Class code asked for, NULL for the full domain. A full-domain phrase wins; then the first class near a mapping word."""
    hit = []
    for code, words in V.SCOPE_ALIASES:
        w = "(?:" + "|".join(words) + ")"
        pat = f"{w}.{{0,18}}有机质|有机质.{{0,18}}{w}|(?:做|绘制|制作|生成|输出|显示|预测|制图).{{0,18}}{w}|{w}.{{0,18}}(?:图|预测)"
        hit.append(F.when(c.rlike(pat), F.lit(code)))
    return F.when(~c.rlike(V.FULL_DOMAIN), F.coalesce(*hit))


def parse_data_name(c: Column) -> Column:
    """Priority names first, then the longest alias of any name."""
    low = F.lower(c)
    first = [(a, n) for n in V.PRIORITY_DATA for a in V.DATA_ALIASES[n]]
    rest = sorted(((a, n) for n, al in V.DATA_ALIASES.items() for a in al if n not in V.PRIORITY_DATA), key=lambda p: -len(p[0]))
    return _first_alias(low, first + rest)


def request_spec(c: Column) -> Column:
    scope = parse_landcover_scope(c)
    return F.struct(
        parse_year(c).alias("year"),
        parse_region(c).alias("region"),
        parse_resolution(c).alias("resolution_m"),
        parse_crs(c).alias("crs"),
        parse_reference_name(c).alias("reference"),
        scope.alias("class_code"),
        F.when(scope == 1, "cropland").when(scope.isNotNull(), "landcover_class").otherwise("full_domain").alias("map_scope"),
        parse_data_name(c).alias("data_name"),
    )


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Collapsed blanks, corrected typing mistakes, single punctuation."""
    def fixed(t):
        for bad, good in V.TYPOS.items():
            t = F.replace(t, F.lit(bad), F.lit(good))
        return t

    wrong = "|".join(V.TYPOS)
    t = let(squeeze(c), lambda t: F.when(t.rlike(wrong), fixed(t)).otherwise(t))
    return squeeze(F.regexp_replace(t, "[，,。；;]{2,}", "，"))


def infer_domain(c: Column) -> Column:
    """Vocabulary with more terms in the text."""
    score = lambda t, words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))
    both = let(F.lower(c), lambda t: F.struct(score(t, V.SOIL_TERMS).alias("s"), score(t, V.CAR_TERMS).alias("a")))
    return let(both, lambda b: F.when((b["s"] == 0) & (b["a"] == 0), "unknown").when(b["s"] >= b["a"], "soil_dsm").otherwise("auto_dsm"))


def strip_admin_suffix(c: Column) -> Column:
    """One administrative suffix, when something is left before it."""
    t = F.trim(c)
    out = [F.when(t.endswith(s) & (F.length(t) > len(s)), F.left(t, F.length(t) - len(s))) for s in V.ADMIN_SUFFIXES]
    return F.coalesce(*out, t)


def safe_name(c: Column, most: int = 80) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("x")), "[^0-9A-Za-z一-鿿._-]+", "_")
    return F.coalesce(F.nullif(F.left(F.btrim(t, F.lit("._-")), F.lit(most)), F.lit("")), F.lit("x"))


def region_code(c: Column, most: int = 10) -> Column:
    """Readable short code; a hash where the name carries nothing."""
    n = safe_name(F.coalesce(c, F.lit("aoi")), most)
    return F.when(n != "aoi", n).otherwise(F.concat(F.lit("aoi_"), F.left(F.md5(F.coalesce(c, F.lit("aoi"))), F.lit(8))))


def safe_filename(c: Column) -> Column:
    """Base name without illegal characters; reserved stems get an underscore; at most 120 characters."""
    base = F.trim(F.element_at(F.split(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "/"), -1))
    base = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", "_"), r'[<>:"/\\|?*]+', "_")
    base = F.btrim(base, F.lit(" ."))
    base = F.when(F.length(base) > 0, base).otherwise("upload.bin")
    suf = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    stem = F.left(base, F.length(base) - F.length(suf))
    stem = F.when(F.upper(stem).isin(V.RESERVED_NAMES), F.concat(F.lit("_"), stem)).otherwise(stem)
    return F.concat(F.left(stem, F.greatest(F.lit(16), F.lit(120) - F.length(suf))), suf)


def truncate(c: Column, n: int) -> Column:
    """Line breaks become blanks; text over n characters ends in an ellipsis."""
    t = F.trim(F.regexp_replace(c, r"[\r\n]+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)


def covariate_of(name: Column) -> Column:
    """Covariate named by the longest alias in a file name."""
    norm = F.regexp_replace(F.lower(name), r"[\s_\-]+", "")
    pairs = sorted(((re.sub(r"[\s_\-]+", "", a.lower()), n) for n, al in V.COVARIATE_ALIASES.items() for a in al), key=lambda p: -len(p[0]))
    return _first_alias(norm, pairs)


def file_role(path: Column, has_lon: Column, has_lat: Column, has_target: Column) -> Column:
    """Struct role, confidence, can_model (yes, no or a condition), matched covariate."""
    name = F.element_at(F.split(path, "/"), -1)
    low = F.lower(name)
    ext = F.regexp_extract(low, r"(\.[^.]*)$", 1)
    cov = covariate_of(name)
    none = F.lit(None).cast("string")
    r = lambda role, conf, can, c=None: F.struct(
        F.lit(role).alias("role"), F.lit(float(conf)).alias("confidence"), F.lit(can).alias("can_model"), (none if c is None else c).alias("covariate")
    )
    table = F.when(has_lon & has_lat & has_target, r("sample_points", 0.96, "training_target")).when(
        has_lon & has_lat, r("covariate_table_points", 0.72, "after_interpolation", cov)
    ).otherwise(r("unknown_table", 0.45, "no"))
    raster = (
        F.when(low.rlike("mask|cropland|admin|boundary|clip|掩膜|边界|耕地"), r("mask_raster", 0.88, "no"))
        .when(low.rlike("som|soc|organic|prediction|pred|有机质|预测"), r("target_prediction_raster", 0.82, "no"))
        .when(cov.isin("CLCD", "LULCcd"), r("covariate_categorical", 0.92, "yes", cov))
        .when(cov.isNotNull(), r("covariate_raster", 0.92, "yes", cov))
        .otherwise(r("covariate_raster", 0.68, "yes"))
    )
    vector = F.when(low.rlike("admin|boundary|aoi|行政|边界|区划"), r("admin_boundary", 0.82, "no")).otherwise(r("vector_unknown", 0.55, "after_rasterization"))
    multi = F.when(cov.isNotNull(), r("multidimensional_covariate", 0.76, "after_conversion", cov)).otherwise(r("multidimensional_covariate", 0.62, "after_conversion"))
    return (
        F.when(ext.isin(".csv", ".txt", ".xls", ".xlsx"), table)
        .when(ext.isin(".tif", ".tiff"), raster)
        .when(ext.isin(".nc", ".hdf", ".h5", ".hdf5"), multi)
        .when(ext.isin(".shp", ".gpkg", ".geojson", ".json"), vector)
        .when(ext == ".zip", r("archive_package", 0.6, "no"))
        .otherwise(r("unknown", 0.3, "no"))
    )


def spatial_scales(region: Column, parents: Column) -> Column:
    """The area, its parents, the nation: ordered, without repeats."""
    sub = region.rlike("[省市区县州盟旗]$")
    nat = F.when(sub, F.array(F.lit("全国"), F.lit("中国"))).otherwise(F.array(F.lit("中国")))
    own = F.when(region.isNotNull() & (region != ""), F.array(region)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.coalesce(parents, F.array().cast("array<string>")), nat))


def progress_of(line: Column) -> Column:
    """Stage percentage a log line reaches, NULL when it says nothing."""
    return let(line, _progress)


def _progress(line: Column) -> Column:
    low = F.lower(line)
    part = lambda pat: (F.regexp_extract(line, pat, 1).try_cast("int"), F.regexp_extract(line, pat, 2).try_cast("int"))
    # Counters of the two parameter searches.
    i1, n1 = part(r"(?i)Clean RFK (?:正在评分)?\s*候选参数\s*(\d+)\s*/\s*(\d+)")
    i2, n2 = part(r"(?i)可出图特征RFK(?:正在评分|联合寻参)?(?:候选参数)?\s*(\d+)\s*/\s*(\d+)")
    step = lambda base, span, i, n: F.lit(base) + F.floor(F.lit(span) * i / F.greatest(n, F.lit(1))).cast("int")
    mark = lambda ms: [F.when(low.contains(m), F.lit(p)) for m, p in ms]
    return F.coalesce(
        *mark(V.PROGRESS_MARKS),
        F.when(n1.isNotNull(), step(55, 17, i1, n1)),
        F.when(n2.isNotNull(), step(72, 8, i2, n2)),
        *mark(V.PROGRESS_LATE),
    )
