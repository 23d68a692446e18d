"""Queries: filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.operators import gates as G
from loamgrid.operators import schema as S
from loamgrid.operators import rules
from loamgrid.plans.registry import query
from loamgrid.plans.views import layout, raster_cells, raw_samples, samples, table, wide

r6 = lambda c, n: F.round(c, 6).alias(n)
FEATS = ["c_size", "c_cyc", "c_zero", "f_qty", "f_disc", "f_tax", "f_price"]
NUM = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"


def _core(spark, sf):
    r = raw_samples(spark, sf).select("sample_id", C.extract_numeric(F.col("som_text")).alias("som"))
    return samples(spark, sf).drop("som").join(r, "sample_id")


CORE = f"core as (select s.sample_id, s.lon, s.lat, try_cast(nullif(regexp_extract(som_text, '{NUM}', 1), '') as double) as som from samples s join raw_samples r on s.sample_id = r.sample_id)"


@query("filter_valid_core", f"with {CORE} select sample_id, som from core where som is not null", ("raw_samples",))
def q_core(spark, sf):
    return G.filter_valid_core(_core(spark, sf)).select("sample_id", "som")


@query(
    "filter_lonlat_range",
    "select o_orderkey from orders where o_totalprice / 1500.0::double - 60 between -180 and 180 and o_totalprice / 2500.0::double - 20 between -90 and 90",
)
def q_range(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").filter(G.in_lonlat_range(p / 1500.0 - 60, p / 2500.0 - 20)).select("o_orderkey")


@query(
    "flag_outliers_3iqr",
    """with v as (select l_orderkey, sum(l_extendedprice * l_discount) / 100.0::double as v from lineitem group by 1), v3 as (select l_orderkey, v * v * v as v from v), q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from v3)
select v > b + 3.0::double * (b - a) or v < a - 3.0::double * (b - a) as outlier, count(*) as n, round(min(v), 4) as mn from v3, q group by 1""",
)
def q_outlier(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / 100.0).alias("v"))
    v = v.select("l_orderkey", (F.col("v") * F.col("v") * F.col("v")).alias("v"))
    return G.flag_outliers_3iqr(v, "v").groupBy("outlier").agg(F.count("*").alias("n"), F.round(F.min("v"), 4).alias("mn"))


@query(
    "preprocess_samples",
    f"""with {CORE}, k as (select * from core where som is not null and lon between -180 and 180 and lat between -90 and 90)
select (select count(*) from core) as rows_before, count(*) as rows_after, count(*) - (select count(*) from (select distinct lon, lat from k)) as duplicate_xy, min(som) as som_min, max(som) as som_max from k""",
    ("raw_samples",),
)
def q_pre(spark, sf):
    return G.preprocess_samples(_core(spark, sf))


@query(
    "duplicate_xy_count",
    "select count(*) - (select count(*) from (select distinct o_custkey, o_orderpriority from orders)) as duplicates, count(*) as rows from orders",
)
def q_dup(spark, sf):
    return G.duplicate_xy_count(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query(
    "filter_leakage_columns",
    "select feature, n from (select count(c_size) as c_size, count(c_cyc) as c_cyc, count(c_zero) as c_zero, count(landcover) as landcover, count(sample_year) as sample_year, count(f_qty) as f_qty, count(f_disc) as f_disc, count(f_tax) as f_tax, count(f_price) as f_price from wide) unpivot (n for feature in (c_size, c_cyc, c_zero, landcover, sample_year, f_qty, f_disc, f_tax, f_price))",
    ("wide",),
)
def q_leak(spark, sf):
    w = wide(spark, sf)
    w = w.select("*", F.col("som").alias("soc_map_old"), F.col("x").alias("coord_x"), F.col("y").alias("src_y"))
    keep = [c for c in w.columns if not S.is_leak_column(c, "som")]
    return S.unpivot(w, keep).groupBy("feature").agg(F.count("value").alias("n"))


@query(
    "drop_sparse_constant_features",
    """with m as (select count(*) as n from wide), u as (select feature, count(v) as valid, count(distinct v) as d from (select c_size, c_cyc, c_zero, f_qty, case when sample_id = 5 then 1.0::double end as rare, 3.0::double as flat from wide)
  unpivot include nulls (v for feature in (c_size, c_cyc, c_zero, f_qty, rare, flat)) group by feature)
select feature, case when 1 - valid::double / n >= 0.98 then false when d <= 1 then false else true end as keep, case when 1 - valid::double / n >= 0.98 then 'sparse' when d <= 1 then 'constant' else 'kept' end as reason, round(1 - valid::double / n, 6) as missing_rate from u, m""",
    ("wide",),
)
def q_sparse(spark, sf):
    w = wide(spark, sf).select("c_size", "c_cyc", "c_zero", "f_qty", F.when(F.col("sample_id") == 5, 1.0).alias("rare"), F.lit(3.0).alias("flat"))
    return G.drop_sparse_constant_features(w, w.columns).withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "feature_quality_gate",
    """with m as (select count(*) as n from wide), u as (select feature, count(v) as valid from (select c_size, c_zero, f_qty, case when sample_id % 3 = 0 then 1.0::double end as third, null::double as empty from wide)
  unpivot include nulls (v for feature in (c_size, c_zero, f_qty, third, empty)) group by feature)
select feature, round(1 - valid::double / n, 6) as missing_rate, valid, valid > 0 and (1 - valid::double / n > 0.25 or valid < 50) as flag, valid > 0 as keep from u, m""",
    ("wide",),
)
def q_quality(spark, sf):
    w = wide(spark, sf).select("c_size", "c_zero", "f_qty", F.when(F.col("sample_id") % 3 == 0, 1.0).alias("third"), F.lit(None).cast("double").alias("empty"))
    return G.feature_quality_gate(w, w.columns).withColumn("missing_rate", F.round("missing_rate", 6))


MISSN = " + ".join(f"case when {c} is null then 1 else 0 end" for c in FEATS)


@query("row_missing_gate", f"select sample_id, missing_n, round(missing_n / 7.0::double, 6) as missing_rate from (select sample_id, {MISSN} as missing_n from wide) where missing_n / 7.0 <= 0.5", ("wide",))
def q_rowgate(spark, sf):
    return G.row_missing_gate(wide(spark, sf), FEATS).select("sample_id", "missing_n", r6("missing_rate", "missing_rate"))


@query("row_missing_counts", f"select sample_id, {MISSN} as missing_n, round(({MISSN}) / 7.0::double, 6) as missing_rate from wide", ("wide",))
def q_rowmiss(spark, sf):
    n = G.row_missing(FEATS)
    return wide(spark, sf).select("sample_id", n.alias("missing_n"), r6(n / 7, "missing_rate"))


@query("core_row_gate", "select sample_id from wide where som is not null and coalesce(c_zero, f_qty, f_disc) is not null", ("wide",))
def q_coregate(spark, sf):
    return G.core_row_gate(wide(spark, sf), "som", ["c_zero", "f_qty", "f_disc"]).select("sample_id")


@query(
    "is_missing_value",
    """with c as (select l_orderkey, l_linenumber, l_returnflag as name, case when l_orderkey % 13 = 0 then 1e31::double when l_orderkey % 11 = 0 then 'nan'::double when l_orderkey % 7 = 0 then -9999.0::double
  when l_orderkey % 5 = 0 then 0.0::double else l_quantity end as v, case when l_linenumber % 2 = 0 then 0.0::double else -9999.0::double end as nd, l_linestatus = 'O' and l_linenumber = 3 as masked from lineitem)
select coalesce(case when masked and v = 0 then null when masked then 'masked' when isnan(v) then 'nonfinite' when abs(v) >= 1e30 then 'extreme_fill_value' when abs(v - nd) <= 1e-9 and abs(nd) <= 1e-12 then null
  when abs(v - nd) <= 1e-9 then 'nodata' end, 'present') as reason, count(*) as n from c group by 1""",
)
def q_missing(spark, sf):
    k = F.col("l_orderkey")
    v = F.when(k % 13 == 0, 1e31).when(k % 11 == 0, float("nan")).when(k % 7 == 0, -9999.0).when(k % 5 == 0, 0.0).otherwise(F.col("l_quantity"))
    nd = F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(-9999.0)
    masked = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3)
    d = table(spark, sf, "lineitem").select(F.coalesce(C.missing_reason(v, nd, F.col("l_returnflag"), masked), F.lit("present")).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "is_categorical_layer",
    """select layer, layer = 'class' or bool_and("value" = floor("value")) or count(distinct "value") <= 20 as categorical from raster_cells group by layer""",
    ("raster_cells",),
)
def q_cat(spark, sf):
    vc = raster_cells(spark, sf).groupBy("layer", "value").agg(F.count("*").alias("m"))
    p = vc.groupBy("layer").agg(F.count("value").alias("d"), F.bool_and(F.col("value") == F.floor("value")).alias("i"))
    return p.select("layer", G.is_categorical_layer(F.col("layer"), F.col("d"), F.col("i")).alias("categorical"))


PATHS = """paths as (select p_partkey, '/data/2021/' || p_name || case p_partkey % 6 when 0 then '_ndvi_2019_2023' when 1 then '_ndvi' when 2 then '_dem' when 3 then '_clcd_1990' when 4 then '_npp_2001' else '_2022' end || '.tif' as path from part)"""


def _paths(spark, sf):
    m = F.col("p_partkey") % 6
    tail = F.when(m == 0, "_ndvi_2019_2023").when(m == 1, "_ndvi").when(m == 2, "_dem").when(m == 3, "_clcd_1990").when(m == 4, "_npp_2001").otherwise("_2022")
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/data/2021/"), "p_name", tail, F.lit(".tif")).alias("path"))


@query(
    "temporal_compatibility",
    f"""with {PATHS} select p_partkey, case p_partkey % 6 when 0 then 'year_inside' when 1 then 'undated_dynamic' when 2 then 'undated_static' when 3 then 'mask_exempt' when 4 then 'year_outside' else 'year_inside' end as reason,
p_partkey % 6 <> 4 as accepted from paths""",
)
def q_temporal(spark, sf):
    return G.temporal_compatibility(_paths(spark, sf), "path", 2022).drop("path")


@query("files_matching_year", f"with {PATHS} select p_partkey from paths where contains(path, '_2022') or not exists (select 1 from paths where contains(path, '_2022'))")
def q_year_files(spark, sf):
    return files_matching_year(_paths(spark, sf), "path", 2022).select("p_partkey")


def files_matching_year(df, path, year):
    """Files naming the year in the base name; all of them when none does."""
    hit = F.element_at(F.split(path, "/"), -1).contains(str(year))
    some = df.select(F.bool_or(hit)).scalar()
    return df.filter(hit | ~some)


@query(
    "covariate_selection",
    """with a(alias) as (values ('ring'), ('bolt'), ('blue')), x(alias) as (values ('blue'))
select p_partkey from part where exists (select 1 from a where contains(lower(p_name), a.alias)) and not exists (select 1 from x where contains(lower(p_name), x.alias))""",
)
def q_selection(spark, sf):
    return covariate_selection(table(spark, sf, "part"), F.lower("p_name"), ["ring", "bolt", "blue"], ["blue"]).select("p_partkey")


def covariate_selection(df, name, wanted, excluded=()):
    """Rows whose name holds a wanted alias and no excluded one; no wanted alias means all."""
    keep = C.contains_any(name, list(wanted)) if wanted else F.lit(True)
    return df.filter(keep & ~C.contains_any(name, list(excluded))) if excluded else df.filter(keep)


@query(
    "select_sources",
    """select s_suppkey, s_name, row_number() over (partition by s_nationkey order by case when s_suppkey % 3 = 0 then 0 when s_suppkey % 3 = 1 then 1 else 2 end, s_acctbal, s_suppkey) as pos from supplier where s_suppkey % 3 <> 2""",
)
def q_sources(spark, sf):
    from pyspark.sql import Window

    rank = F.when(F.col("s_suppkey") % 3 == 0, "user").when(F.col("s_suppkey") % 3 == 1, "domestic").otherwise("foreign")
    s = select_sources(table(spark, sf, "supplier").withColumn("grp", rank), "grp", "domestic")
    w = Window.partitionBy("s_nationkey").orderBy("group_rank", "s_acctbal", "s_suppkey")
    return s.select("s_suppkey", "s_name", F.row_number().over(w).alias("pos"))


def select_sources(df, group, mode):
    """Sources allowed by the mode, with their group rank (user, domestic, auxiliary, foreign)."""
    allowed = {"user": ["user"], "domestic": ["user", "domestic"], "all": ["user", "domestic", "auxiliary", "foreign"]}[mode]
    order = F.array_position(F.array(*[F.lit(g) for g in ("user", "domestic", "auxiliary", "foreign")]), F.col(group))
    return df.filter(F.col(group).isin(allowed)).withColumn("group_rank", order)


@query(
    "valid_class_codes",
    """with c as (select l_orderkey, l_linenumber, l_quantity / 4.0::double as code from lineitem)
select code, count(*) as n, count(*) filter (not (abs(code - round_even(code, 0)) <= 1e-6 and round_even(code, 0) between 1 and 9)) as invalid from c group by code""",
)
def q_codes(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_quantity") / 4.0).alias("code"))
    return d.withColumn("k", C.class_code(F.col("code"))).groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("code").isNotNull() & F.col("k").isNull()).alias("invalid"))


def _stack(spark, sf):
    from loamgrid.operators.raster import feature_stack

    return feature_stack(raster_cells(spark, sf), ["qty", "disc", "class"])


STACK = """st as (select "row", "col", max(case when layer = 'qty' then "value" end) as qty, max(case when layer = 'disc' and ("row" + "col") % 9 <> 0 then "value" end) as disc, max(case when layer = 'class' then "value" end) as class from raster_cells group by 1, 2)"""


def _gappy(spark, sf):
    from loamgrid.operators.raster import feature_stack

    c = raster_cells(spark, sf).withColumn("value", F.when((F.col("layer") != "disc") | ((F.col("row") + F.col("col")) % 9 != 0), F.col("value")))
    return feature_stack(c, ["qty", "disc", "class"])


@query("landcover_target_mask", f'with {STACK} select "row", "col", qty from st where class = 1', ("raster_cells",))
def q_lcmask(spark, sf):
    return landcover_target_mask(_gappy(spark, sf), "class", 1).select("row", "col", "qty")


def landcover_target_mask(cells, class_col, target, full_domain=False):
    """Cells of the target class. A missing mask layer is an error, never a silent full map."""
    if full_domain:
        return cells
    if class_col not in cells.columns:
        raise ValueError(f"no mask layer {class_col}")
    return cells.filter(F.rint(class_col) == target)


@query("deployable_cell_filter", f'with {STACK} select "row", "col" from st where qty is not null and disc is not null and class between 1 and 5', ("raster_cells",))
def q_deploy(spark, sf):
    return deployable_cells(_gappy(spark, sf), ["qty", "disc"], F.col("class").between(1, 5)).select("row", "col")


def deployable_cells(cells, features, mask=None, max_missing=0.999):
    """Cells with every feature (and inside the mask); an almost empty layer stops the map."""
    n = cells.agg(F.count(F.lit(1)).alias("__n"), *[F.count(f) for f in features]).first()
    empty = [f for f, v in zip(features, n[1:]) if n["__n"] and 1 - v / n["__n"] >= max_missing]
    if empty:
        raise ValueError(f"layers without values on the map: {empty}")
    full = cells.dropna(subset=features)
    return full.filter(mask) if mask is not None else full


@query("complete_stack_mask", f'with {STACK} select "row", "col", qty is not null and disc is not null and class is not null as valid from st', ("raster_cells",))
def q_complete(spark, sf):
    ok = F.col("qty").isNotNull() & F.col("disc").isNotNull() & F.col("class").isNotNull()
    return _gappy(spark, sf).select("row", "col", ok.alias("valid"))


@query("resolution_acceptable", "select p_partkey, p_size * 10 <= 250 as ok from part")
def q_resok(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rules.resolution_acceptable(F.col("p_size") * 10, F.lit(250)).alias("ok"))


@query("valid_year", "select sample_year, count(*) as n, bool_and(sample_year - 20 between 1980 and 2035) as ok from samples group by 1", ("samples",))
def q_vyear(spark, sf):
    return samples(spark, sf).groupBy("sample_year").agg(F.count("*").alias("n"), F.bool_and(C.valid_year(F.col("sample_year") - 20)).alias("ok"))


META = """meta as (select layer, min("col") * (select res from layout) as x0, 180000.0::double - min("row" + case when layer = 'disc' then 4 else 0 end) * (select res from layout) as y0, any_value((select res from layout)) as res, max("col") - min("col") + 1 as width, max("row") - min("row") + 1 as height,
  case when layer = 'class' then 'EPSG:4326' else 'EPSG:32648' end as crs from raster_cells group by layer)"""


def raster_meta(spark, sf):
    res = layout(spark, sf).res
    c = raster_cells(spark, sf).withColumn("row", F.col("row") + F.when(F.col("layer") == "disc", 4).otherwise(0))
    return c.groupBy("layer").agg(
        (F.min("col") * res).alias("x0"),
        (F.lit(180000.0) - F.min("row") * res).alias("y0"),
        F.lit(res).alias("res"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        (F.max("row") - F.min("row") + 1).alias("height"),
    ).withColumn("crs", F.when(F.col("layer") == "class", "EPSG:4326").otherwise("EPSG:32648"))


@query(
    "grid_matches",
    f"""with {META}, r as (select * from meta where layer = 'qty')
select m.layer, m.crs = r.crs and m.width = r.width and m.height = r.height and abs(m.x0 - r.x0) <= 1e-8 and abs(m.y0 - r.y0) <= 1e-8 and abs(m.res - r.res) <= 1e-8 as matches,
case when m.crs <> r.crs and not (m.width = r.width and m.height = r.height and abs(m.x0 - r.x0) <= 1e-8 and abs(m.y0 - r.y0) <= 1e-8 and abs(m.res - r.res) <= 1e-8) then 'both' when m.crs <> r.crs then 'reprojected'
 when not (m.width = r.width and m.height = r.height and abs(m.x0 - r.x0) <= 1e-8 and abs(m.y0 - r.y0) <= 1e-8 and abs(m.res - r.res) <= 1e-8) then 'aligned' else 'none' end as action from meta m, r""",
    ("raster_cells",),
)
def q_matches(spark, sf):
    return grid_matches(raster_meta(spark, sf), "qty")


def grid_matches(meta, reference):
    """Each layer against the reference layer: same grid or not, and what has to be done."""
    cols = ["x0", "y0", "res", "width", "height", "crs"]
    ref = meta.filter(F.col("layer") == reference).select(F.struct(*cols)).scalar()
    d = meta.withColumn("r", ref)
    same = (F.col("width") == F.col("r.width")) & (F.col("height") == F.col("r.height"))
    for c in ("x0", "y0", "res"):
        same = same & (F.abs(F.col(c) - F.col(f"r.{c}")) <= 1e-8)
    crs = F.col("crs") == F.col("r.crs")
    act = F.when(~crs & ~same, "both").when(~crs, "reprojected").when(~same, "aligned").otherwise("none")
    return d.select("layer", (crs & same).alias("matches"), act.alias("action"))
