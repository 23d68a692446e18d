"""Queries: header inference, sample loading, feature lists, derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.functions import projection as P
from loamgrid.operators import schema as S
from loamgrid.operators import rules
from loamgrid.plans.registry import query
from loamgrid.plans.views import raw_samples, raster_cells, samples, table, wide

r6 = lambda c, n: F.round(c, 6).alias(n)

HDR = r"[\s_\-()（）\[\]【】{}:：/\\.%％]+"


@query("normalize_header", f"select p_partkey, lower(regexp_replace(trim(p_type || ' (' || p_name || '): ' || p_brand || ' %'), '{HDR}', '', 'g')) as h from part")
def q_header(spark, sf):
    raw = F.concat("p_type", F.lit(" ("), "p_name", F.lit("): "), "p_brand", F.lit(" %"))
    return table(spark, sf, "part").select("p_partkey", C.normalize_header(raw).alias("h"))


def _messy(spark, sf):
    """Samples under foreign headers, with text values."""
    s = samples(spark, sf).join(raw_samples(spark, sf).drop("file_name"), "sample_id")
    return s.select(
        F.col("sample_id").alias("点号"),
        F.col("lon_text").alias("Longitude (WGS84)"),
        F.col("lat").alias("纬度"),
        F.col("som_text").alias("OM (g/kg)"),
        "sample_year",
        "c_size",
        "c_cyc",
        "c_zero",
        F.lit(250).alias("target_scale_m"),
        F.lit(7.0).alias("flat"),
        F.col("som").alias("pred_old"),
    )


@query(
    "infer_core_fields",
    """select 'lon' as field, 'Longitude (WGS84)' as col, count(lon_text) as n from raw_samples union all select 'lat', '纬度', count(lat) from samples
union all select 'som', 'OM (g/kg)', count(som_text) from raw_samples union all select 'sample_id', '点号', count(sample_id) from samples
union all select 'year', 'sample_year', count(sample_year) from samples""",
    ("raw_samples",),
)
def q_infer(spark, sf):
    m = _messy(spark, sf)
    found = S.infer_core_fields(m.columns)
    counts = m.agg(*[F.count(c).alias(f) for f, c in found.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("col"), F.col(f).alias("n")) for f, c in found.items()])).alias("r")).select("r.*")


@query(
    "pick_first_existing",
    "select 'y_true' as role, 'som' as col, round(avg(som), 6) as mean from samples union all select 'x', 'x', round(avg(x), 6) from samples union all select 'size', 'c_size', round(avg(c_size), 6) from samples",
    ("samples",),
)
def q_pick(spark, sf):
    s = samples(spark, sf)
    roles = {"y_true": ["y_true", "som_value", "som"], "x": ["x_32648", "x"], "size": ["grain", "size"]}
    found = {r: S.pick_first_existing(s.columns, c, r) for r, c in roles.items()}
    a = s.agg(*[F.avg(c).alias(r) for r, c in found.items()])
    return a.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("col"), r6(r, "mean")) for r, c in found.items()])).alias("r")).select("r.*")


NUM = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"


@query(
    "extract_numeric",
    rf"""select sample_id, try_cast(nullif(regexp_extract(lon_text, '{NUM}', 1), '') as double) as lon1000, try_cast(nullif(regexp_extract(som_text, '{NUM}', 1), '') as double) as som from raw_samples""",
    ("raw_samples",),
)
def q_extract(spark, sf):
    return raw_samples(spark, sf).select("sample_id", C.extract_numeric(F.col("lon_text")).alias("lon1000"), C.extract_numeric(F.col("som_text")).alias("som"))


@query("coerce_numeric", "select sample_id, try_cast(replace(som_text, ' g/kg', '') as double) as som from raw_samples", ("raw_samples",))
def q_coerce(spark, sf):
    return raw_samples(spark, sf).select("sample_id", C.coerce_numeric(F.replace("som_text", F.lit(" g/kg"))).alias("som"))


@query(
    "load_samples",
    f"""select s.sample_id as id, try_cast(regexp_extract(lon_text, '{NUM}', 1) as double) as lon, s.lat, try_cast(nullif(regexp_extract(som_text, '{NUM}', 1), '') as double) as som, c_size, c_cyc, c_zero
from samples s join raw_samples r on s.sample_id = r.sample_id where som_text <> 'n/a'""",
    ("raw_samples",),
)
def q_load(spark, sf):
    out, _ = S.load_samples(_messy(spark, sf), "点号")
    return out.withColumnRenamed("点号", "id")


@query(
    "covariate_column_decision",
    """select * from (values ('点号', false, 'core'), ('Longitude (WGS84)', false, 'core'), ('纬度', false, 'core'), ('OM (g/kg)', false, 'core'), ('sample_year', false, 'core'),
 ('target_scale_m', false, 'metadata'), ('pred_old', false, 'leakage')) t("column", keep, reason) cross join (select null::bigint as valid, null::bigint as "distinct")
union all select 'c_size', true, 'kept', count(c_size), count(distinct c_size) from samples union all select 'c_cyc', true, 'kept', count(c_cyc), count(distinct c_cyc) from samples
union all select 'c_zero', true, 'kept', count(c_zero), count(distinct c_zero) from samples union all select 'flat', false, 'constant', count(*), 1 from samples""",
    ("samples",),
)
def q_decision(spark, sf):
    m = _messy(spark, sf)
    return S.covariate_decision(m, S.infer_core_fields(m.columns).values())


@query("load_training_table", "select som, c_size, c_cyc, c_zero, landcover, sample_year, f_qty, f_disc, f_tax, f_price from wide", ("wide",))
def q_training(spark, sf):
    return S.load_training_table(wide(spark, sf), "som")


@query(
    "detect_target_coord_columns",
    "select 'target' as role, 'som' as col, count(som) as n from samples union all select 'x', 'x', count(x) from samples union all select 'y', 'y', count(y) from samples union all select 'lon', 'lon', count(lon) from samples union all select 'lat', 'lat', count(lat) from samples",
    ("samples",),
)
def q_detect(spark, sf):
    s = samples(spark, sf)
    roles = {"target": ["som_value", "som", "y_true"], "x": ["x_32648", "proj_x", "x"], "y": ["y_32648", "proj_y", "y"], "lon": ["lon", "longitude"], "lat": ["lat", "latitude"]}
    found = {r: next(c for c in cands if c in s.columns) for r, cands in roles.items()}
    a = s.agg(*[F.count(c).alias(r) for r, c in found.items()])
    return a.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("col"), F.col(r).alias("n")) for r, c in found.items()])).alias("r")).select("r.*")


@query(
    "auto_detect_features",
    """select feature, valid from (select count(c_size) as c_size, count(c_cyc) as c_cyc, count(c_zero) as c_zero, count(landcover) as landcover, count(sample_year) as sample_year,
count(f_qty) as f_qty, count(f_disc) as f_disc, count(f_tax) as f_tax, count(f_price) as f_price, count(*) as n from wide)
unpivot (valid for feature in (c_size, c_cyc, c_zero, landcover, sample_year, f_qty, f_disc, f_tax, f_price)) where valid >= greatest(8, floor(n * 0.2))""",
    ("wide",),
)
def q_autodetect(spark, sf):
    w = wide(spark, sf)
    feats = S.auto_detect_features(w, "som")
    return S.unpivot(w, feats).groupBy("feature").agg(F.count("value").alias("valid"))


@query(
    "normalize_feature_name",
    r"""select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('COV_GEE_' || p_type || '_' || p_brand || '_250m.tif'), '^cov_gee_', ''), '\.tif$', ''), '_250m$', '_250m'), '[^0-9a-z一-鿿]+', '', 'g') as n from part""",
)
def q_fname(spark, sf):
    raw = F.concat(F.lit("COV_GEE_"), "p_type", F.lit("_"), "p_brand", F.lit("_250m.tif"))
    return table(spark, sf, "part").select("p_partkey", C.normalize_feature_name(raw).alias("n"))


@query(
    "dedupe_feature_names",
    r"""select p_partkey, case when n > 1 then b || '_' || n else b end as feature from (select p_partkey, regexp_replace(trim(p_name), '\s+', '_', 'g') as b,
row_number() over (partition by p_brand, regexp_replace(trim(p_name), '\s+', '_', 'g') order by p_partkey) as n from part)""",
)
def q_dedupe(spark, sf):
    return S.dedupe_feature_names(table(spark, sf, "part"), "p_name", "p_partkey", ["p_brand"]).select("p_partkey", "feature")


@query(
    "project_local_metric",
    "select sample_id, round(radians(lon) * 6371000.0::double * cos(radians((select avg(lat) from samples))), 3) as mx, round(radians(lat) * 6371000.0::double, 3) as my from samples",
    ("samples",),
)
def q_project(spark, sf):
    return S.project_local_metric(samples(spark, sf)).select("sample_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"))


D = lambda v: f"{v:.17e}::double"
SUM_OF = lambda coefs, f, g, u, v: " + ".join(f"{D(c)} * {f}({2 * (j + 1)} * {u}) * {g}({2 * (j + 1)} * {v})" for j, c in enumerate(coefs))
#: Latitudes reach south of the equator and longitudes go around the globe, so that zones and both grids are met.
PLACES = "places as (select sample_id, lon + 30.0::double * (sample_id % 12) - 180 as lon, case when sample_id % 2 = 0 then lat else -lat end as lat from (select sample_id, lon - 100 as lon, lat from samples))"
UTM = f"""{PLACES}, zoned as (select *, cast(floor((lon + 180) / 6) as bigint) % 60 + 1 as zone from places),
c as (select *, sinh(atanh(sin(radians(lat))) - {D(P.E)} * atanh({D(P.E)} * sin(radians(lat)))) as t, radians(lon - (zone * 6 - 183)) as l from zoned),
d as (select *, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t * t)) as eta from c),
utm as (select *, {D(P.UTM_SCALE * P.RECTIFYING)} * (eta + {SUM_OF(P.ALPHA, "cos", "sinh", "xi", "eta")}) + 500000 as e, {D(P.UTM_SCALE * P.RECTIFYING)} * (xi + {SUM_OF(P.ALPHA, "sin", "cosh", "xi", "eta")}) + case when lat < 0 then 10000000 else 0 end as n from d)"""


def _places(spark, sf):
    s = samples(spark, sf)
    lon = F.col("lon") - 100.0 + 30.0 * (F.col("sample_id") % 12) - 180.0
    return s.select("sample_id", lon.alias("lon"), F.when(F.col("sample_id") % 2 == 0, F.col("lat")).otherwise(-F.col("lat")).alias("lat"))


@query("project_utm", f"with {UTM} select sample_id, zone, round(e, 3) as mx, round(n, 3) as my from utm", ("samples",))
def q_utm(spark, sf):
    return S.project_metric(_places(spark, sf), "utm").select("sample_id", "zone", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"))


@query("project_utm_inverse", f"with {PLACES} select sample_id, round(lon, 9) as lon, round(lat, 9) as lat from places", ("samples",))
def q_utm_back(spark, sf):
    d = S.project_metric(_places(spark, sf), "utm")
    lon, lat = P.utm_inverse(F.col("mx"), F.col("my"), F.col("zone"), F.col("lat") < 0)
    return d.select("sample_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


CONE = P.Albers(25.0, 47.0, 0.0, 105.0)
_N, _C, _R0 = CONE.cone


@query(
    "project_albers",
    f"""with q as (select sample_id, lon, {D(1 - P.E2)} * (sin(radians(lat)) / (1 - {D(P.E2)} * pow(sin(radians(lat)), 2)) + atanh({D(P.E)} * sin(radians(lat))) / {D(P.E)}) as q from samples),
r as (select sample_id, {D(P.SEMI_MAJOR / _N)} * sqrt({D(_C)} - {D(_N)} * q) as r, {D(_N)} * radians(lon - 105) as turn from q)
select sample_id, round(r * sin(turn), 3) as mx, round({D(_R0)} - r * cos(turn), 3) as my from r""",
    ("samples",),
)
def q_albers(spark, sf):
    return S.project_metric(samples(spark, sf).select("sample_id", "lon", "lat"), CONE).select("sample_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"))


@query("project_albers_inverse", "select sample_id, round(lon, 9) as lon, round(lat, 9) as lat from samples", ("samples",))
def q_albers_back(spark, sf):
    lon, lat = CONE.inverse(F.col("mx"), F.col("my"))
    return S.project_metric(samples(spark, sf), CONE).select("sample_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(
    "coordinate_features",
    """with c as (select avg(lon) as x0, avg(lat) as y0, greatest(max(lon) - min(lon), 1e-6) as sx, greatest(max(lat) - min(lat), 1e-6) as sy from samples)
select sample_id, round((lon - x0) / sx, 6) as coord_lon_norm, round((lat - y0) / sy, 6) as coord_lat_norm, round(sqrt(((lon - x0) / sx) * ((lon - x0) / sx) + ((lat - y0) / sy) * ((lat - y0) / sy)), 6) as coord_dist_center,
round(((lon - x0) / sx) * ((lat - y0) / sy), 6) as coord_lon_lat_interaction, round(sin(radians(lon)), 6) as coord_sin_lon, round(cos(radians(lat)), 6) as coord_cos_lat from samples, c""",
    ("samples",),
)
def q_coordf(spark, sf):
    d = S.coordinate_features(samples(spark, sf))
    return d.select("sample_id", *[r6(c, c) for c in d.columns if c.startswith("coord_")])


@query(
    "source_status_features",
    """with st as (select count(*) filter (event_type = 'view') as view_n, count(*) filter (event_type = 'error') as error_n from events)
select sample_id, view_n, error_n from samples, st""",
    ("samples",),
)
def q_source_features(spark, sf):
    return source_status_features(samples(spark, sf).select("sample_id"), table(spark, sf, "events"), "event_type", ["view", "error"])


def source_status_features(df, status, key, names):
    """Constant columns with the count per source, from one conditional aggregate."""
    st = status.agg(F.struct(*[F.count_if(F.col(key) == n).alias(f"{n}_n") for n in names])).scalar()
    return df.withColumn("__s", st).select(*df.columns, "__s.*")


@query(
    "one_hot_classes",
    "select sample_id, " + ", ".join(f"case when landcover = {k} then 1.0::double else 0.0::double end as landcover__class_{k}" for k in V.LANDCOVER) + " from samples",
    ("samples",),
)
def q_onehot(spark, sf):
    d = S.one_hot_classes(samples(spark, sf).select("sample_id", F.col("landcover").cast("double").alias("landcover")), "landcover")
    return d.drop("landcover")


@query(
    "missing_indicators",
    "select sample_id, case when c_zero is null then 1.0::double else 0.0::double end as c_zero__missing from samples",
    ("samples",),
)
def q_missind(spark, sf):
    d = S.missing_indicators(samples(spark, sf), ["c_size", "c_cyc", "c_zero"])
    return d.select("sample_id", *[c for c in d.columns if c.endswith("__missing")])


@query("scale_offset", 'select layer, "row", "col", round("value" * 0.02::double - 273.15::double, 6) as v from raster_cells', ("raster_cells",))
def q_scale(spark, sf):
    return raster_cells(spark, sf).select("layer", "row", "col", r6(scale_offset(F.col("value"), 0.02, -273.15), "v"))


def scale_offset(value, scale, offset=0.0):
    return value * F.lit(float(scale)) + F.lit(float(offset))


@query(
    "terrain_aspect_sincos",
    "select l_orderkey, l_linenumber, round(sin(radians(l_quantity * 7.2::double)), 6) as s, round(cos(radians(l_quantity * 7.2::double)), 6) as c from lineitem",
)
def q_aspect(spark, sf):
    s, c = rules.aspect_sincos(F.col("l_quantity") * 7.2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(s, "s"), r6(c, "c"))


@query("twi_proxy", "select l_orderkey, l_linenumber, round(ln(1.0::double / (tan(radians(l_quantity)) + 0.001::double)), 6) as twi from lineitem")
def q_twi(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(twi_proxy(F.col("l_quantity")), "twi"))


def twi_proxy(slope_deg):
    """ln(1 / (tan(slope) + 0.001))."""
    return F.log(F.lit(1.0) / (F.tan(F.radians(slope_deg)) + F.lit(0.001)))


@query(
    "derived_soil_climate",
    "select l_orderkey, l_linenumber, round(100.0::double - l_quantity - l_tax * 100, 6) as silt, round((l_quantity + l_discount * 100) / 2, 6) as tmean, round(l_quantity - l_discount * 100, 6) as trange, round(l_quantity - l_tax * 100, 6) as pr_pet from lineitem",
)
def q_soil(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    mean, span = rules.middle_and_range(q, d)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(rules.silt(q, t), "silt"), r6(mean, "tmean"), r6(span, "trange"), r6(rules.water_balance(q, t), "pr_pet")
    )


@query("reorder_columns", "select som, lon, lat, sample_id, x, y, c_size, c_cyc, c_zero, landcover, sample_year from samples", ("samples",))
def q_reorder(spark, sf):
    return S.reorder_columns(samples(spark, sf), ["som", "lon", "lat", "absent"])


@query(
    "replace_missing_sentinel",
    "select sample_id, c_size, case when sample_id % 7 = 0 then null else c_zero end as c_zero from samples",
    ("samples",),
)
def q_sentinel(spark, sf):
    s = samples(spark, sf).select("sample_id", "c_size", F.coalesce("c_zero", F.lit(-9999.0)).alias("c_zero"), F.lit(-9999.0).alias("empty"))
    return S.replace_missing_sentinel(s, ["c_size", "c_zero", "empty"])
