"""Queries: joins in space, raster cells, grids and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.operators import raster as R
from loamgrid.operators.gazetteer import admin_name_match, alias_match
from loamgrid.operators.ordering import exact_quantiles, global_rank
from loamgrid.operators import rules
from loamgrid.plans.registry import query
from loamgrid.plans.views import GRID_TOP, areas, grid, layout, raster_cells, samples, table

r6 = lambda c, n: F.round(c, 6).alias(n)
TOP = GRID_TOP


# ---------------------------------------------------------------- joins


@query(
    "join_covariates_by_id",
    """with r as (select l_partkey, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as n from lineitem) where n = 1)
select sample_id, som, l_extendedprice as cov from samples left join r on sample_id = l_partkey""",
    ("samples",),
)
def q_join_id(spark, sf):
    right = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sample_id"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("cov"))
    return join_by_id(samples(spark, sf).select("sample_id", "som"), right, "sample_id", ["l_orderkey", "l_linenumber"], ["cov"])


def join_by_id(left, right, key, order, cols):
    """Left join after the right side keeps its first row per key (min of a struct combines map-side)."""
    first = right.groupBy(key).agg(F.min(F.struct(*order, *cols)).alias("__f"))
    return left.join(first, key, "left").select(*left.columns, *[F.col(f"__f.{c}").alias(c) for c in cols])


@query(
    "join_positional",
    """select a.o_orderkey, b.o_custkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders) a
join (select o_custkey, row_number() over (order by o_custkey, o_orderkey) as rn from orders) b using (rn)""",
)
def q_positional(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey")
    b = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("tie"))
    return join_positional(a, ["o_orderkey"], b, ["o_custkey", "tie"], ["o_custkey"])


def join_positional(a, a_order, b, b_order, cols):
    """Row-order join of tables of equal length; other lengths give NULL columns.

    Both sides get a global row number from range buckets of the first order column, so no
    side is sorted in one task.
    """
    same = a.select(F.count("*")).scalar() == b.select(F.count("*")).scalar()
    na, nb = global_rank(a, a_order, "__rn"), global_rank(b, b_order, "__rn").select("__rn", *cols).filter(same)
    return na.join(nb, "__rn", "left").drop("__rn")


@query("point_in_polygon", "select sample_id, area_id from inside", ("inside",))
def q_pip(spark, sf):
    return R.polygon_join(samples(spark, sf), areas(spark, sf)).select("sample_id", "area_id")


@query(
    "spatial_join_admin",
    "select s.sample_id, coalesce(a.name, 'unmatched') as name from samples s left join inside i on s.sample_id = i.sample_id left join areas a on a.area_id = i.area_id",
    ("inside",),
)
def q_admin(spark, sf):
    return R.polygon_join(samples(spark, sf), areas(spark, sf), how="left").select("sample_id", F.coalesce("name", F.lit("unmatched")).alias("name"))


BOXES = """boxes as (select name, 'city' as level, parent as province, ax as x0, ay as y0, ax + 60000 as x1, ay + 50000 as y1, row_number() over (order by area_id) as pos from areas
union all select parent, 'province', parent, min(ax) - 5000, min(ay) - 5000, max(ax) + 30000, max(ay) + 30000, 1000 + row_number() over (order by parent) from areas group by parent)"""


def _boxes(spark, sf):
    a = areas(spark, sf).withColumn("x0", F.array_min(F.transform("edges", lambda e: e["x1"]))).withColumn("y0", F.array_min(F.transform("edges", lambda e: e["y1"])))
    # The area table is an administrative list: numbering it is bounded work.
    city = a.select(
        "name", F.lit("city").alias("level"), F.col("parent").alias("province"), "x0", "y0", (F.col("x0") + 60000).alias("x1"), (F.col("y0") + 50000).alias("y1"),
        F.row_number().over(Window.orderBy("area_id")).alias("pos"),
    )
    prov = a.groupBy("parent").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x0").alias("c"), F.max("y0").alias("d")).select(
        F.col("parent").alias("name"), F.lit("province").alias("level"), F.col("parent").alias("province"), (F.col("a") - 5000).alias("x0"), (F.col("b") - 5000).alias("y0"),
        (F.col("c") + 30000).alias("x1"), (F.col("d") + 30000).alias("y1"), (F.row_number().over(Window.orderBy("parent")) + 1000).alias("pos"),
    )
    return city.unionByName(prov)


def first_box(points, boxes, key, tile=50000.0):
    """First box in list order that holds the point; tile equi join, then the smallest position."""
    seq = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    b = boxes.withColumn("__tx", seq("x0", "x1")).withColumn("__ty", seq("y0", "y1"))
    p = points.select(key, "x", "y", F.floor(F.col("x") / tile).alias("__px"), F.floor(F.col("y") / tile).alias("__py"))
    hit = p.join(b, (F.col("__px") == F.col("__tx")) & (F.col("__py") == F.col("__ty")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    best = hit.groupBy(key).agg(F.min(F.struct("pos", "level", "name", "province")).alias("b"))
    return points.select(key).join(best, key, "left").select(key, "b.level", "b.name", "b.province")


@query(
    "point_in_bbox_first",
    f"""with {BOXES}, h as (select sample_id, level, b.name, province, row_number() over (partition by sample_id order by pos) as rn from samples s join boxes b on s.x between b.x0 and b.x1 and s.y between b.y0 and b.y1)
select s.sample_id, level, h.name, province from samples s left join h on s.sample_id = h.sample_id and rn = 1""",
    ("samples", "areas"),
)
def q_bbox(spark, sf):
    return first_box(samples(spark, sf), _boxes(spark, sf), "sample_id")


CELLAT = 'cast(floor((180000 - s.y) / (select res from layout)) as int) as "row", cast(floor(s.x / (select res from layout)) as int) as "col"'


@query(
    "sample_raster_at_points",
    f"""with p as (select sample_id, {CELLAT} from samples s) select sample_id, "value" as qty from p left join raster_cells r on r.layer = 'qty' and p."row" = r."row" and p."col" = r."col\"""",
    ("samples", "raster_cells"),
)
def q_sample_one(spark, sf):
    return R.sample_at_points(samples(spark, sf), raster_cells(spark, sf), ["qty"], 0.0, TOP, layout(spark, sf).res).select("sample_id", "qty")


@query(
    "stack_sample_layers",
    f"""with p as (select sample_id, {CELLAT} from samples s) select sample_id, max(case when layer = 'qty' then "value" end) as qty, max(case when layer = 'disc' then "value" end) as disc, max(case when layer = 'class' then "value" end) as class
from p left join raster_cells r on p."row" = r."row" and p."col" = r."col" group by sample_id""",
    ("samples", "raster_cells"),
)
def q_sample_stack(spark, sf):
    return R.sample_at_points(samples(spark, sf), raster_cells(spark, sf), ["qty", "disc", "class"], 0.0, TOP, layout(spark, sf).res).select("sample_id", "qty", "disc", "class")


def _shifted(spark, sf):
    return grid(spark, sf).withColumn("x", F.col("x") + 1200.0).withColumn("y", F.col("y") - 700.0)


@query(
    "align_raster_nearest",
    """select g."row", g."col", r."value" from grid g left join raster_cells r on r.layer = 'class' and r."row" = floor((180000 - (g.y - 700)) / (select res from layout)) and r."col" = floor((g.x + 1200) / (select res from layout))""",
    ("grid", "raster_cells"),
)
def q_nearest(spark, sf):
    return R.align_nearest(raster_cells(spark, sf).filter("layer = 'class'"), _shifted(spark, sf), 0.0, TOP, layout(spark, sf).res)


@query(
    "align_raster_bilinear",
    """with f as (select "row", "col", (x + 1200) / (select res from layout) - 0.5::double as fx, (180000 - (y - 700)) / (select res from layout) - 0.5::double as fy from grid),
e as (select f."row", f."col", floor(fy) + dr as r, floor(fx) + dc as c, (case when dr = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) * (case when dc = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as w
  from f cross join (values (0), (1)) a(dr) cross join (values (0), (1)) b(dc))
select e."row", e."col", round(sum(w * v."value") / sum(w), 3) as "value" from e join raster_cells v on v.layer = 'qty' and v."row" = e.r and v."col" = e.c where w > 0 group by 1, 2""",
    ("grid", "raster_cells"),
)
def q_bilinear(spark, sf):
    a = R.align_bilinear(raster_cells(spark, sf).filter("layer = 'qty'"), _shifted(spark, sf), 0.0, TOP, layout(spark, sf).res)
    return a.select("row", "col", F.round("value", 3).alias("value"))


@query(
    "feature_stack_join",
    """select "row", "col", max(case when layer = 'qty' then "value" end) as qty, max(case when layer = 'disc' then "value" end) as disc, max(case when layer = 'class' then "value" end) as class from raster_cells group by 1, 2""",
    ("raster_cells",),
)
def q_stack(spark, sf):
    return R.feature_stack(raster_cells(spark, sf), ["qty", "disc", "class"])


@query(
    "mask_grid_join",
    """select g."row", g."col", case when r."row" <= 2 or r."value" is null then 255 when r."value" <= 3 then 1 else 0 end as mask from grid g left join (select * from raster_cells where layer = 'class') r on g."row" = r."row" and r."col" = g."col" """,
    ("grid", "raster_cells"),
)
def q_maskjoin(spark, sf):
    m = raster_cells(spark, sf).filter("layer = 'class'").select("row", "col", F.when(F.col("row") > 2, (F.col("value") <= 3).cast("int")).alias("m"))
    return grid(spark, sf).join(m, ["row", "col"], "left").select("row", "col", F.coalesce("m", F.lit(255)).alias("mask"))


@query(
    "feature_raster_match",
    r"""with l as (select distinct p_name as layer, lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) as k from part), f as (select p_partkey, case when p_partkey % 2 = 0 then p_name else upper(replace(p_name, ' ', '_')) || '_250m' end as feature from part)
select f.p_partkey, coalesce(e.layer, n.layer) as layer, case when e.layer is not null then 'exact' when n.layer is not null then 'normalized' else 'none' end as how from f left join l e on f.feature = e.layer
left join l n on regexp_replace(regexp_replace(lower(f.feature), '_250m$', ''), '[^0-9a-z]+', '', 'g') = n.k""",
)
def q_match(spark, sf):
    p = table(spark, sf, "part")
    feats = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_250m"))).alias("feature"))
    return feature_raster_match(feats, p.select(F.col("p_name").alias("layer")).distinct()).select("p_partkey", "layer", "how")


def feature_raster_match(features, layers):
    """Layer of a feature by exact name, else by normalised name: two equi joins, exact wins."""
    ex = layers.select("layer")
    nm = layers.groupBy(C.normalize_feature_name(F.col("layer")).alias("__k")).agg(F.min("layer").alias("__nl"))
    j = features.join(ex, F.col("feature") == F.col("layer"), "left").withColumn("__f", C.normalize_feature_name(F.col("feature"))).join(nm, F.col("__f") == F.col("__k"), "left")
    how = F.when(F.col("layer").isNotNull(), "exact").when(F.col("__nl").isNotNull(), "normalized").otherwise("none")
    return j.select(*features.columns, F.coalesce("layer", "__nl").alias("layer"), how.alias("how"))


@query(
    "match_companion_file",
    """with s as (select p_partkey, p_brand as folder, replace(p_name, ' ', '_') as stem from part where p_partkey % 3 = 0), t as (select p_partkey as tk, p_brand as folder, replace(p_name, ' ', '_') || case p_partkey % 3 when 1 then '_bands' else '_band_list' end as stem from part where p_partkey % 3 <> 0),
j as (select s.p_partkey, t.tk, 10 + case when t.stem = s.stem || '_bands' then 100 else 0 end + case when starts_with(t.stem, s.stem) and contains(t.stem, 'band') then 80 else 0 end + case when contains(t.stem, 'band') then 20 else 0 end as score from s join t on s.folder = t.folder),
r as (select *, row_number() over (partition by p_partkey order by score desc, tk) as rn from j) select p_partkey, tk, score from r where rn = 1""",
)
def q_companion(spark, sf):
    p = table(spark, sf, "part").withColumn("stem", F.replace("p_name", F.lit(" "), F.lit("_")))
    m = F.col("p_partkey") % 3
    stacks = p.filter(m == 0).select("p_partkey", F.col("p_brand").alias("folder"), "stem")
    tables = p.filter(m != 0).select(F.col("p_partkey").alias("tk"), F.col("p_brand").alias("folder"), F.concat("stem", F.when(m == 1, "_bands").otherwise("_band_list")).alias("tstem"))
    return match_companion(stacks, tables)


def match_companion(stacks, tables):
    """Band table of a stack: 100 for the exact name, 80 for the prefix, 20 for the word, 10 for the folder.

    Tables of one folder with the same stem score alike, so only the first of them can win:
    they collapse before the folder join and the pairs per folder stay few.
    """
    t = tables.groupBy("folder", "tstem").agg(F.min("tk").alias("tk"))
    s = stacks.select("folder", "stem").distinct()
    named = F.col("tstem").contains("band")
    score = 10 + F.when(F.col("tstem") == F.concat("stem", F.lit("_bands")), 100).otherwise(0) + F.when(F.col("tstem").startswith(F.col("stem")) & named, 80).otherwise(0) + F.when(named, 20).otherwise(0)
    best = s.join(t, "folder").groupBy("folder", "stem").agg(F.min(F.struct((-score).alias("neg"), "tk")).alias("b"))
    return stacks.join(best, ["folder", "stem"]).select("p_partkey", "b.tk", (-F.col("b.neg")).alias("score"))


@query(
    "choose_landcover_layer",
    """with f as (select p_partkey, p_brand, '/lc/' || case when p_partkey % 2 = 0 then 'clcd_' else 'x_' end || (2015 + p_partkey % 9) || case when p_partkey % 5 = 0 then '_30m' else '' end || '.tif' as path, p_size * 1024 as size from part),
s as (select *, case when contains(path, 'clcd') then 50 else 0 end + case when contains(path, '2020') then 100 else 0 end + case when contains(path, '30') then 10 else 0 end as score from f)
select p_brand, p_partkey, score from (select *, row_number() over (partition by p_brand order by score desc, size // 1024 desc, length(path), p_partkey) as rn from s) where rn = 1""",
)
def q_lc(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/lc/"), F.when(k % 2 == 0, "clcd_").otherwise("x_"), (F.lit(2015) + k % 9).cast("string"), F.when(k % 5 == 0, "_30m").otherwise(""), F.lit(".tif"))
    f = table(spark, sf, "part").select(k, "p_brand", path.alias("path"), (F.col("p_size") * 1024).alias("size"))
    return choose_landcover(f, "p_brand", 2020).select("p_brand", "p_partkey", "score")


def choose_landcover(files, by, year):
    """Best class layer per group by keyword, year and resolution, then size, then shorter path."""
    name = F.element_at(F.split("path", "/"), -1)
    score = (
        F.when(C.contains_any(F.lower(name), ["clcd", "landcover", "land_cover", "lulc", "worldcover"]), 50).otherwise(0)
        + F.when(C.contains_any(F.col("path"), ["土地覆盖", "土地利用", "地表覆盖"]), 40).otherwise(0)
        + F.when(name.contains(str(year)), 100).otherwise(0)
        + F.when(name.contains("30"), 10).otherwise(0)
    )
    best = files.groupBy(by).agg(
        F.min(F.struct((-score).alias("neg"), (-F.floor(F.col("size") / 1024)).alias("sz"), F.length("path").alias("ln"), "p_partkey")).alias("b")
    )
    return best.select(by, "b.p_partkey", (-F.col("b.neg")).alias("score"))


ALIASES = """al(alias, target, level) as (select n_name, n_name, 200 from nation union all select r_name, r_name, 100 from region union all select substr(n_name, 1, 4), n_name, 50 from nation)"""


@query(
    "text_alias_join",
    f"""with {ALIASES}, t as (select o_orderkey, 'map of ' || c_name || ' ' || n_name || ' ' || case when o_orderkey % 2 = 0 then r_name else '' end as txt from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
h as (select o_orderkey, target, level + length(alias) as score, row_number() over (partition by o_orderkey order by level + length(alias) desc, alias, target) as rn from t join al on contains(txt, alias))
select o_orderkey, target, score from h where rn = 1""",
)
def q_alias(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    txt = F.concat_ws(" ", F.lit("map of"), "c_name", "n_name", F.when(F.col("o_orderkey") % 2 == 0, F.col("r_name")).otherwise(""))
    al = n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("target"), F.lit(200).alias("level")).unionByName(
        r.select(F.col("r_name").alias("alias"), F.col("r_name").alias("target"), F.lit(100).alias("level"))
    ).unionByName(n.select(F.substring("n_name", 1, 4).alias("alias"), F.col("n_name").alias("target"), F.lit(50).alias("level")))
    return alias_match(o.select("o_orderkey", txt.alias("txt")), "txt", al).filter("target is not null").select("o_orderkey", "target", "score")


SUFSQL = "(" + "|".join(V.ADMIN_SUFFIXES) + ")$"


@query(
    "admin_name_match",
    f"""with q as (select distinct c_mktsegment || '市' as q from customer), c as (select distinct case when c_custkey % 3 = 0 then c_mktsegment || '市' when c_custkey % 3 = 1 then c_mktsegment else c_mktsegment || '县城' end as c from customer)
select q, c, case when q = c then 'equal' when regexp_replace(q, '{SUFSQL}', '') = regexp_replace(c, '{SUFSQL}', '') then 'stripped' else 'contained' end as how from q join c on q = c or regexp_replace(q, '{SUFSQL}', '') = regexp_replace(c, '{SUFSQL}', '')
 or contains(c, regexp_replace(q, '{SUFSQL}', '')) or contains(q, regexp_replace(c, '{SUFSQL}', ''))""",
)
def q_adminname(spark, sf):
    c = table(spark, sf, "customer")
    m = F.col("c_custkey") % 3
    names = c.select(F.when(m == 0, F.concat("c_mktsegment", F.lit("市"))).when(m == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("县城"))).alias("c")).distinct()
    qs = c.select(F.concat("c_mktsegment", F.lit("市")).alias("q")).distinct()
    return admin_name_match(qs, names)


@query(
    "parent_filter_join",
    """select a.area_id, c.c_custkey from (select area_id, name, parent from areas) a join (select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey ) c on a.name = c.n_name and a.parent = c.r_name""",
    ("areas",),
)
def q_parent(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    req = c.select("c_custkey", F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return rules.parent_filter_join(areas(spark, sf), req).select("area_id", "c_custkey")


@query(
    "parent_by_max_overlap",
    """with c as (select cast(l_partkey % 97 as int) as child, cast(l_suppkey % 7 as int) as parent, count(*) as n from lineitem group by 1, 2) select child, parent, n from (select *, row_number() over (partition by child order by n desc, parent) as rn from c) where rn = 1""",
)
def q_overlap(spark, sf):
    cells = table(spark, sf, "lineitem").select((F.col("l_partkey") % 97).cast("int").alias("child"), (F.col("l_suppkey") % 7).cast("int").alias("parent"))
    return parent_by_overlap(cells)


def parent_by_overlap(cells):
    """Parent with the most shared cells per child, smallest name on a tie."""
    n = cells.groupBy("child", "parent").agg(F.count("*").alias("n"))
    b = n.groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("neg"), "parent")).alias("b"))
    return b.select("child", "b.parent", (-F.col("b.neg")).alias("n"))


@query(
    "missing_covariates_anti",
    """select p_partkey, case when p_type in ('ECONOMY', 'SMALL') then 'priority' when p_type = 'PROMO' then 'derivable' else 'optional' end as status from part where not exists (select 1 from lineitem where l_partkey = p_partkey group by l_partkey having max(l_quantity) > 49)""",
)
def q_anti(spark, sf):
    have = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("most")).filter("most > 49")
    m = table(spark, sf, "part").join(have, F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    st = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "priority").when(F.col("p_type") == "PROMO", "derivable").otherwise("optional")
    return m.select("p_partkey", st.alias("status"))


@query("manifest_features_semi", "select distinct p_name as feature from part where exists (select 1 from lineitem where l_partkey = p_partkey group by l_partkey having max(l_tax) >= 0.08)")
def q_semi(spark, sf):
    used = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_tax").alias("most")).filter("most >= 0.08")
    return table(spark, sf, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_name").alias("feature")).distinct()


@query("weights_left_join", "select p_partkey, round(coalesce(w, 0), 6) as weight from part left join (select l_partkey, sum(l_discount) as w from lineitem group by 1) on l_partkey = p_partkey")
def q_wjoin(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_discount").alias("w"))
    return table(spark, sf, "part").join(w, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", r6(F.coalesce("w", F.lit(0.0)), "weight"))


# ---------------------------------------------------------------- grids and masks


@query(
    "make_grid",
    """with b as (select floor((min(x) - 1) / 2500) * 2500 as x0, ceil((max(y) + 1) / 2500) * 2500 as y0, ceil((max(x) + 1) / 2500) - floor((min(x) - 1) / 2500) as w, ceil((max(y) + 1) / 2500) - floor((min(y) - 1) / 2500) as h from samples),
g as (select cast(r as int) as "row", cast(c as int) as "col", x0 + (c + 0.5::double) * 2500 as x, y0 - (r + 0.5::double) * 2500 as y from b, unnest(range(0, cast(h as bigint))) t(r), unnest(range(0, cast(w as bigint))) u(c)),
n as (select floor((y0 - y) / 2500) as r, floor((x - x0) / 2500) as c, count(*) as n from samples, b group by 1, 2)
select g."row", g."col", x, y, coalesce(n, 0) as n from g left join n on n.r = g."row" and n.c = g."col\"""",
    ("samples",),
)
def q_grid(spark, sf):
    s = samples(spark, sf)
    b = s.agg(F.struct((F.min("x") - 1).alias("xmin"), (F.min("y") - 1).alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax")).alias("b"))
    g = R.make_grid(F.col("b"), 2500.0, b)
    o = b.select(F.struct((F.floor(F.col("b.xmin") / 2500) * 2500).alias("x0"), (F.ceil(F.col("b.ymax") / 2500) * 2500).alias("y0"))).scalar()
    p = s.withColumn("o", o).select(F.floor((F.col("o.y0") - F.col("y")) / 2500).alias("row"), F.floor((F.col("x") - F.col("o.x0")) / 2500).alias("col"))
    n = p.groupBy("row", "col").agg(F.count("*").alias("n"))
    return g.join(n, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "resolve_bounds",
    """with d as (select min(x) as a, min(y) as b, max(x) as c, max(y) as d from samples)
select area_id, case when area_id % 3 = 0 then 'area' else 'samples' end as source, round(case when area_id % 3 = 0 then ax - 200 else a - greatest((c - a) * 0.12::double, 2000) end, 6) as xmin, round(case when area_id % 3 = 0 then ay - 200 else b - greatest((d - b) * 0.12::double, 2000) end, 6) as ymin,
round(case when area_id % 3 = 0 then ax + 60200 else c + greatest((c - a) * 0.12::double, 2000) end, 6) as xmax, round(case when area_id % 3 = 0 then ay + 50200 else d + greatest((d - b) * 0.12::double, 2000) end, 6) as ymax from areas, d""",
    ("samples", "areas"),
)
def q_bounds(spark, sf):
    s = samples(spark, sf)
    e = lambda f, k1, k2: f(F.transform("edges", lambda x: F.least(x[k1], x[k2]) if f is F.array_min else F.greatest(x[k1], x[k2])))
    own = F.struct(
        (e(F.array_min, "x1", "x2") - 200).alias("xmin"), (e(F.array_min, "y1", "y2") - 200).alias("ymin"), (e(F.array_max, "x1", "x2") + 200).alias("xmax"), (e(F.array_max, "y1", "y2") + 200).alias("ymax")
    )
    a = areas(spark, sf).withColumn("own", F.when(F.col("area_id") % 3 == 0, own))
    return resolve_bounds(a, s, 0.12, 2000.0).select("area_id", "source", *[r6(f"b.{c}", c) for c in ("xmin", "ymin", "xmax", "ymax")])


def resolve_bounds(areas_df, samples_df, share, least):
    """Own area bounds first, else the padded sample box."""
    px, py = F.greatest((F.max("x") - F.min("x")) * share, F.lit(least)), F.greatest((F.max("y") - F.min("y")) * share, F.lit(least))
    box = samples_df.agg(F.struct((F.min("x") - px).alias("xmin"), (F.min("y") - py).alias("ymin"), (F.max("x") + px).alias("xmax"), (F.max("y") + py).alias("ymax"))).scalar()
    d = areas_df.withColumn("__s", box)
    return d.withColumn("source", F.when(F.col("own").isNotNull(), "area").otherwise("samples")).withColumn("b", F.coalesce("own", "__s")).drop("__s")


@query(
    "coarsen_resolution",
    """with recursive q as (select o_orderkey as id, 30.0::double as req, greatest(1, ceil(o_totalprice / 30)) * greatest(1, ceil(o_totalprice / 60)) as pts, o_totalprice as w from orders),
s as (select id, w, req as res, pts from q where pts <= 200000 union all
 select id, w, r, greatest(1, ceil(w / r)) * greatest(1, ceil(w / 2 / r)) from (select id, w, ceil(req * sqrt(pts / 200000.0::double) / 10) * 10 as r from q where pts > 200000)),
it as (select id, w, res, pts from s union all select id, w, r, greatest(1, ceil(w / r)) * greatest(1, ceil(w / 2 / r)) from (select id, w, ceil(res * 1.08::double / 10) * 10 as r from it where pts > 200000))
select id as o_orderkey, res, cast(pts as bigint) as cells from it where pts <= 200000""",
)
def q_coarsen(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("w"), (F.col("o_totalprice") / 2).alias("h"))
    return coarsen_resolution(o, "w", "h", 30.0, 200_000).select("o_orderkey", "res", "cells")


def coarsen_resolution(df, w, h, requested, budget, steps=40):
    """Cell size that fits a cell budget: square-root scaling rounded up to 10, then 8 % steps."""
    cells = lambda r: F.greatest(F.lit(1), F.ceil(F.col(w) / r)) * F.greatest(F.lit(1), F.ceil(F.col(h) / r))
    start = F.lit(float(requested))
    first = F.ceil(start * F.sqrt(cells(start) / F.lit(float(budget))) / 10) * F.lit(10.0)
    res = F.when(cells(start) <= budget, start).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda r, _: F.when(cells(r) > budget, F.ceil(r * 1.08 / 10) * F.lit(10.0)).otherwise(r))
    )
    d = df.withColumn("res", res)
    return d.withColumn("cells", cells(F.col("res")).cast("long"))


META = """meta as (select layer, min("col") * (select res from layout) as x0, 180000.0::double - min("row" + case when layer = 'disc' then 4 else 0 end) * (select res from layout) as y0, any_value((select res from layout)) as res, max("col") - min("col") + 1 as width, max("row") - min("row") + 1 as height from raster_cells group by layer)"""


def _meta(spark, sf):
    from loamgrid.plans.gates import raster_meta

    return raster_meta(spark, sf)


@query("target_grid_from_reference", f"with {META} select layer, x0, y0, 2000.0::double as res, cast(ceil(width * res / 2000) as int) as width, cast(ceil(height * res / 2000) as int) as height from meta", ("raster_cells",))
def q_target(spark, sf):
    return target_grid(_meta(spark, sf), 2000.0).select("layer", "x0", "y0", "res", "width", "height")


def target_grid(meta, res=None):
    """Grid over the reference bounds, at another cell size when one is given."""
    if res is None:
        return meta
    fit = lambda n: F.ceil(F.col(n) * F.col("res") / res).cast("int")
    return meta.withColumn("width", fit("width")).withColumn("height", fit("height")).withColumn("res", F.lit(float(res)))


@query(
    "choose_reference_layer",
    "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by case when contains(p_name, 'bolt') then 0 else 1 end, p_partkey) as rn from part) where rn = 1",
)
def q_ref(spark, sf):
    return choose_reference(table(spark, sf, "part"), "p_brand", "p_name", "bolt", "p_partkey")


def choose_reference(df, by, name, wanted, order):
    """Layer whose name holds the wanted text, else the first."""
    miss = F.when(F.contains(F.lower(name), F.lit(wanted.lower())), 0).otherwise(1)
    return df.groupBy(by).agg(F.min(F.struct(miss.alias("m"), order)).alias("b")).select(by, f"b.{order}")


GIN = """gin as (select g."row", g."col", area_id from grid g cross join area_edges e group by g."row", g."col", area_id, g.x, g.y having sum(case when (y1 > g.y) <> (y2 > g.y) and g.x < x1 + (g.y - y1) * (x2 - x1) / (y2 - y1) then 1 else 0 end) % 2 = 1
 or bool_or(abs((g.x - x1) * (y2 - y1) - (g.y - y1) * (x2 - x1)) <= 1e-9 and g.x between least(x1, x2) and greatest(x1, x2) and g.y between least(y1, y2) and greatest(y1, y2)))"""


@query("rasterize_polygon", f'with {GIN} select g."row", g."col", case when count(area_id) > 0 then 1 else 0 end as mask from grid g left join gin i on g."row" = i."row" and g."col" = i."col" group by 1, 2', ("grid", "area_edges"))
def q_rasterize(spark, sf):
    hit = R.polygon_join(grid(spark, sf), areas(spark, sf)).select("row", "col").distinct().withColumn("m", F.lit(1))
    return grid(spark, sf).join(hit, ["row", "col"], "left").select("row", "col", F.coalesce("m", F.lit(0)).alias("mask"))


@query(
    "binary_class_mask",
    """with m as (select case when r."value" is null or r."col" >= 40 then 255 when r."value" = 1 then 1 else 0 end as mask from grid g left join (select * from raster_cells where layer = 'class') r on g."row" = r."row" and g."col" = r."col") select mask, count(*) as n from m group by 1""",
    ("grid", "raster_cells"),
)
def q_binary(spark, sf):
    c = raster_cells(spark, sf).filter("layer = 'class'").select("row", "col", F.when(F.col("col") < 40, F.col("value")).alias("value"))
    m = rules.binary_class_mask(F.col("value"), 1)
    return grid(spark, sf).join(c, ["row", "col"], "left").groupBy(m.alias("mask")).agg(F.count("*").alias("n"))


@query(
    "clip_raster_to_region",
    f"""with {GIN} select r."row", r."col", r."value" from raster_cells r where layer = 'qty' and exists (select 1 from gin i where i."row" = r."row" and i."col" = r."col")""",
    ("grid", "area_edges", "raster_cells"),
)
def q_clip(spark, sf):
    c = raster_cells(spark, sf).filter("layer = 'qty'")
    return clip_to_region(c, areas(spark, sf), 0.0, TOP, layout(spark, sf).res).select("row", "col", "value")


def clip_to_region(cells, region, x0, y0, res):
    """Cells whose centre lies in the region; each cell stays once however many areas hold it."""
    p = cells.withColumn("x", F.lit(x0) + (F.col("col") + 0.5) * res).withColumn("y", F.lit(y0) - (F.col("row") + 0.5) * res)
    hit = R.polygon_join(p.select("row", "col", "x", "y"), region).select("row", "col").distinct()
    return cells.join(hit, ["row", "col"], "left_semi")


@query(
    "choose_band_by_year",
    "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by case when 2000 + p_size % 25 = 2020 then 0 else 1 end, p_partkey) as rn from part) where rn = 1",
)
def q_band(spark, sf):
    return rules.choose_band(table(spark, sf, "part"), ["p_brand"], "p_partkey", F.lit(2000) + F.col("p_size") % 25, 2020)


@query(
    "choose_subdataset",
    """with f as (select p_brand, p_partkey, p_partkey % 6 as idx, case p_partkey % 6 when 0 then 'NDVI_quality' when 1 then 'NDVI' when 2 then 'EVI_QA' when 3 then 'view_angle' when 4 then 'LST' else 'other' end as name from part),
s as (select *, case when name like '%NDVI%' then 100 else 0 end + case when name like '%EVI%' then 100 else 0 end + case when name like '%LST%' then 100 else 0 end - case when regexp_matches(lower(name), 'qa|quality|qc|metadata|view|angle') then 50 else 0 end - idx as score from f)
select p_brand, p_partkey, score from (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as rn from s) where rn = 1""",
)
def q_subset(spark, sf):
    i = F.col("p_partkey") % 6
    name = F.when(i == 0, "NDVI_quality").when(i == 1, "NDVI").when(i == 2, "EVI_QA").when(i == 3, "view_angle").when(i == 4, "LST").otherwise("other")
    f = table(spark, sf, "part").select("p_brand", "p_partkey", i.alias("idx"), name.alias("name"))
    b = f.groupBy("p_brand").agg(F.min(F.struct((-subdataset_score(F.col("name"), F.col("idx"))).alias("neg"), "p_partkey")).alias("b"))
    return b.select("p_brand", "b.p_partkey", (-F.col("b.neg")).alias("score"))


# Words that raise and lower the score of a part of a raster container.
GOOD_PARTS = ["ndvi", "evi", "lst", "precip", "temperature", "soil_moisture", "gpp", "npp", "reflectance"]
BAD_PARTS = ["qa", "quality", "qc", "metadata", "view", "angle"]


def subdataset_score(name, idx):
    low = F.lower(name)
    s = F.lit(0)
    for k in GOOD_PARTS:
        s = s + F.when(low.contains(k), 100).otherwise(0)
    return s - F.when(C.contains_any(low, BAD_PARTS), 50).otherwise(0) - idx


EDGE = """ev as (select layer, case when "row" in (0, (select n_rows - 1 from layout)) or "col" in (0, (select n_cols - 1 from layout)) then 1 else 0 end as e, round(case when layer = 'class' and ("row" in (0, (select n_rows - 1 from layout)) or "col" in (0, (select n_cols - 1 from layout))) and ("row" + "col") % 3 > 0 then 7.0::double else "value" end, 6) as v from raster_cells),
c as (select layer, v, sum(e) as en, count(*) as gn from ev group by 1, 2), t as (select layer, sum(en) as te, sum(gn) as tg from c group by 1),
k as (select c.*, te, tg, row_number() over (partition by c.layer order by en desc, v) as rn from c join t on c.layer = t.layer where en > 0)"""


def _edgy(spark, sf):
    size = layout(spark, sf)
    edge = F.col("row").isin(0, size.rows - 1) | F.col("col").isin(0, size.cols - 1)
    v = F.when((F.col("layer") == "class") & edge & ((F.col("row") + F.col("col")) % 3 > 0), 7.0).otherwise(F.col("value"))
    return raster_cells(spark, sf).withColumn("value", v)


@query(
    "edge_background_values",
    f"""with {EDGE} select layer, v as "value", cast(en as bigint) as edge_n from k where rn <= 6 and te >= 16 and (v in (0, -9999, 9999, -32768, 32767) or en / te::double >= 0.22 or (en / te::double >= 0.12 and gn / tg::double >= 0.08))""",
    ("raster_cells",),
)
def q_edge(spark, sf):
    return edge_background(_edgy(spark, sf), *layout(spark, sf)[:2]).select("layer", "value", "edge_n")


# Fill values that count as background wherever they lead the edge.
SENTINELS = [0.0, -9999.0, 9999.0, -32768.0, 32767.0, -2147483648.0, 2147483647.0]


def edge_background(cells, rows, cols, width=1, top=6):
    """Values that dominate the raster edge, per layer: one aggregation by value, then shares."""
    edge = (F.col("row") < width) | (F.col("row") >= rows - width) | (F.col("col") < width) | (F.col("col") >= cols - width)
    c = cells.filter(F.col("value").isNotNull()).groupBy("layer", F.round("value", 6).alias("value")).agg(F.count_if(edge).alias("edge_n"), F.count("*").alias("n"))
    tot = c.groupBy("layer").agg(F.sum("edge_n").alias("te"), F.sum("n").alias("tn"))
    w = Window.partitionBy("layer").orderBy(F.desc("edge_n"), "value")
    k = c.filter("edge_n > 0").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).join(tot, "layer").filter("te >= 16")
    share, glob = F.col("edge_n") / F.col("te"), F.col("n") / F.col("tn")
    return k.filter(F.col("value").isin(SENTINELS) | (F.abs("value") > 1e20) | (share >= 0.22) | ((share >= 0.12) & (glob >= 0.08)))


FLOOD = """bg as (select "row" as r, "col" as c from raster_cells where layer = 'class' and "value" <= 4), fl(r, c) as (select r, c from bg where r in (0, (select n_rows - 1 from layout)) or c in (0, (select n_cols - 1 from layout)) union select b.r, b.c from fl f join bg b on abs(f.r - b.r) + abs(f.c - b.c) = 1)"""


@query("edge_connected_region", f'with recursive {FLOOD} select r as "row", c as "col" from fl', ("raster_cells",))
def q_flood(spark, sf):
    bg = raster_cells(spark, sf).filter("layer = 'class' and value <= 4")
    return R.edge_connected(bg, *layout(spark, sf)[:2])


@query(
    "raster_valid_mask",
    f"""with recursive bg as (select "row" as r, "col" as c from raster_cells where layer = 'class' and "value" = 7), fl(r, c) as (select r, c from bg where r in (0, (select n_rows - 1 from layout)) or c in (0, (select n_cols - 1 from layout)) union select b.r, b.c from fl f join bg b on abs(f.r - b.r) + abs(f.c - b.c) = 1)
select "row", "col", not (abs("value" - 3) <= 1e-6) and not exists (select 1 from fl where r = "row" and c = "col") as valid from raster_cells where layer = 'class'""",
    ("raster_cells",),
)
def q_valid(spark, sf):
    c = raster_cells(spark, sf).filter("layer = 'class'")
    return raster_valid_mask(c, 3.0, [7.0], *layout(spark, sf)[:2])


def raster_valid_mask(cells, nodata, background, rows, cols):
    """False for missing and nodata cells and for background joined to the edge."""
    close = lambda v: F.abs(F.col("value") - v) <= max(1e-6, abs(v) * 1e-6)
    is_bg = None
    for v in background:
        is_bg = close(v) if is_bg is None else is_bg | close(v)
    out = R.edge_connected(cells.filter(is_bg), rows, cols).withColumn("__o", F.lit(True))
    ok = F.col("value").isNotNull() & ~close(nodata)
    return cells.join(out, ["row", "col"], "left").select("row", "col", (ok & F.col("__o").isNull()).alias("valid"))


@query(
    "percentile_stretch",
    """with q as (select layer, quantile_cont("value", 0.02) as lo, quantile_cont("value", 0.98) as hi from raster_cells group by layer)
select r.layer, "row", "col", cast(floor(least(greatest(("value" - lo) / greatest(hi - lo, 1e-9), 0), 1) * 255) as int) as idx from raster_cells r join q on r.layer = q.layer""",
    ("raster_cells",),
)
def q_stretch(spark, sf):
    return percentile_stretch(raster_cells(spark, sf)).select("layer", "row", "col", "idx")


def percentile_stretch(cells, lo=0.02, hi=0.98):
    """0..255 index between two quantiles per layer; the full range when they coincide."""
    q = exact_quantiles(cells, "value", [lo, hi, 0.0, 1.0], ["layer"])
    flat = F.col("q")[1] <= F.col("q")[0]
    a = F.when(flat, F.col("q")[2]).otherwise(F.col("q")[0])
    b = F.when(flat, F.greatest(F.col("q")[3], F.col("q")[2] + 1.0)).otherwise(F.col("q")[1])
    d = cells.join(q.select("layer", a.alias("__a"), b.alias("__b")), "layer")
    s = F.least(F.greatest((F.col("value") - F.col("__a")) / F.greatest(F.col("__b") - F.col("__a"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return d.withColumn("idx", F.floor(s * 255).cast("int"))


@query("write_back_nodata", """select "row", "col", case when "value" > 25 then "value" else -9999.0::double end as v from raster_cells where layer = 'qty'""", ("raster_cells",))
def q_nodata(spark, sf):
    c = raster_cells(spark, sf).filter("layer = 'qty'")
    return c.select("row", "col", rules.write_back_nodata(F.col("value"), F.col("value") > 25).alias("v"))


@query(
    "map_extent_km",
    """with w as (select c_nationkey, greatest((max(c_acctbal) - min(c_acctbal)) / 100 * 111.32::double * cos(radians(30)), 0.1) as w from customer group by 1)
select c_nationkey, round(w, 6) as width_km, (select max(b) from (values (0.1::double), (0.2), (0.5), (1), (2), (5), (10), (20), (50), (100), (200), (500), (1000)) v(b) where b <= w * 0.2::double or b = 0.1) as scale_km from w""",
)
def q_extent(spark, sf):
    b = table(spark, sf, "customer").groupBy("c_nationkey").agg((F.min("c_acctbal") / 100).alias("west"), (F.max("c_acctbal") / 100).alias("east"))
    b = b.withColumn("w", rules.map_width_km(F.col("west"), F.lit(20.0), F.col("east"), F.lit(40.0)))
    return b.select("c_nationkey", r6(F.col("w"), "width_km"), rules.scale_bar_km(F.col("w")).alias("scale_km"))


@query(
    "focal_window",
    """with q as (select * from raster_cells where layer = 'class'), f as (select a."row", a."col", a."value", avg(b."value") as m, max(b."value") as mx, min(b."value") as mn, count(*) as n from q a join q b on abs(a."row" - b."row") <= 1 and abs(a."col" - b."col") <= 1 group by 1, 2, 3)
select "row", "col", round("value" - m, 5) as tpi, round(mx - mn, 5) as roughness, n from f""",
    ("raster_cells",),
)
def q_focal(spark, sf):
    f = R.terrain_windows(raster_cells(spark, sf).filter("layer = 'class'"))
    return f.select("row", "col", F.round("tpi", 5).alias("tpi"), F.round("relief", 5).alias("roughness"), "n")


@query(
    "block_fraction",
    """select "row" // 3 as br, "col" // 3 as bc, round(avg(case when "value" = 1 then 1.0::double else 0.0::double end), 6) as frac from raster_cells where layer = 'class' group by 1, 2 having avg(case when "value" = 1 then 1.0::double else 0.0::double end) >= 0.05""",
    ("raster_cells",),
)
def q_blockfrac(spark, sf):
    b = block_fraction(raster_cells(spark, sf).filter("layer = 'class'"), 3, 1)
    return b.select("br", "bc", r6("frac", "frac"))


def block_fraction(cells, k, cls, least=0.05):
    """Share of a class in each k x k block; blocks below the least share are left out."""
    hit = (F.rint("value") == cls).cast("double")
    b = cells.groupBy(F.floor(F.col("row") / k).cast("int").alias("br"), F.floor(F.col("col") / k).cast("int").alias("bc")).agg(F.avg(hit).alias("frac"))
    return b.filter(F.col("frac") >= least)


@query("downsample_stride", """select layer, "row", "col", "value" from raster_cells where "row" % 3 = 0 and "col" % 3 = 0""", ("raster_cells",))
def q_stride(spark, sf):
    return rules.downsample_stride(raster_cells(spark, sf), 3)


@query("raster_stats", """select layer, count("value") as n, min("value") as mn, max("value") as mx, round(avg("value"), 6) as mean, round(stddev_pop("value"), 6) as std from raster_cells group by layer""", ("raster_cells",))
def q_stats(spark, sf):
    return raster_stats(raster_cells(spark, sf)).select("layer", "n", "mn", "mx", r6("mean", "mean"), r6("std", "std"))


def raster_stats(cells):
    """Valid count, range, mean and population deviation per layer."""
    return cells.groupBy("layer").agg(
        F.count("value").alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


@query(
    "valid_ratio",
    """select layer, round(count("value") / (select n_rows * n_cols from layout)::double, 6) as ratio, count("value") / (select n_rows * n_cols from layout)::double < 0.2 as warn from raster_cells group by layer""",
    ("raster_cells",),
)
def q_vratio(spark, sf):
    size = layout(spark, sf)
    c = raster_cells(spark, sf).groupBy("layer").agg((F.count("value") / F.lit(float(size.rows * size.cols))).alias("r"))
    return c.select("layer", r6("r", "ratio"), (F.col("r") < 0.2).alias("warn"))


@query(
    "sampling_audit",
    f"""with p as (select sample_id, {CELLAT} from samples s), l(layer) as (values ('qty'), ('disc'), ('class')), j as (select l.layer, case when r."value" is null or r."row" % 4 = 1 then 'masked' when r."value" = 0 then 'zero' else 'valid' end as state from p cross join l
left join raster_cells r on r.layer = l.layer and p."row" = r."row" and p."col" = r."col")
select layer, state, count(*) as n from j group by 1, 2""",
    ("samples", "raster_cells"),
)
def q_audit(spark, sf):
    c = raster_cells(spark, sf).withColumn("value", F.when(F.col("row") % 4 != 1, F.col("value")))
    s = R.sample_at_points(samples(spark, sf), c, ["qty", "disc", "class"], 0.0, TOP, layout(spark, sf).res)
    long = s.unpivot(["sample_id"], ["qty", "disc", "class"], "layer", "value")
    st = F.when(F.col("value").isNull(), "masked").when(F.col("value") == 0, "zero").otherwise("valid")
    return long.groupBy("layer", st.alias("state")).agg(F.count("*").alias("n"))
