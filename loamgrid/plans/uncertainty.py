"""Queries: conformal intervals, applicability, risk (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import uncertainty as U
from loamgrid.operators.neighbors import knn_join, nearest_distance, nearest_line_distance
from loamgrid.operators.ordering import exact_quantile_scalar, running
from loamgrid.plans.registry import query
from loamgrid.plans.views import grid, layout, oof, samples, segments, spread, table
from loamgrid.session import write_and_read


def r6(c, name):
    return F.round(c, 6).alias(name)


NN = """select t.{id} as tid, p.sample_id as pid, p.abs_residual as r, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) as d,
  row_number() over (partition by t.{id} order by sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)), p.sample_id) as rn
  from {targets} t cross join oof p"""


def qhat_ctes(targets: str, idc: str, alpha=0.1, k=60, scale=0.6, min_bw=200.0, p="") -> str:
    """CTEs {p}nn, {p}qh(tid, qhat) for a target relation."""
    return f"""{p}nn as materialized (select * from ({NN.format(id=idc, targets=targets)}) where rn <= {max(5, k)}),
{p}bw as (select tid, greatest({min_bw}::double, max(d) * {scale}::double) as bw from {p}nn group by tid),
{p}ww as (select n.tid, n.r, exp(-0.5::double * (n.d / b.bw) * (n.d / b.bw)) as w from {p}nn n join {p}bw b on n.tid = b.tid),
{p}cw as (select tid, r, sum(w) over (partition by tid order by r, w rows between unbounded preceding and current row) as cum, sum(w) over (partition by tid) as tot from {p}ww where w > 0),
{p}qh as (select tid, min(r) as qhat from {p}cw where cum >= {1 - alpha}::double * tot group by tid)"""


GRID_ID = '(select "row" * (select n_cols from layout) + "col" as cell, * from grid)'


def _grid(spark, sf):
    return grid(spark, sf).withColumn("cell", (F.col("row") * layout(spark, sf).cols + F.col("col")).cast("bigint"))


@query(
    "knn_join_geo",
    f"""with nn as ({NN.format(id="cell", targets=GRID_ID)})
select tid as cell, rn, pid, round(d, 6) as d from nn where rn <= 60""",
    ("grid", "oof"),
)
def q_knn(spark, sf):
    j = knn_join(_grid(spark, sf), oof(spark, sf), 60, carry=["abs_residual"])
    return j.select("cell", F.posexplode("neighbors").alias("pos", "n")).select(
        "cell", (F.col("pos") + 1).alias("rn"), F.col("n.id").alias("pid"), r6(F.col("n.dist"), "d")
    )


@query(
    "local_qhat",
    f"with {qhat_ctes('oof', 'sample_id')} select tid as sample_id, round(qhat, 6) as qhat from qh",
    ("oof",),
)
def q_local_qhat(spark, sf):
    o = oof(spark, sf)
    return U.local_qhat(o, o).select("sample_id", r6("qhat", "qhat"))


@query(
    "nn_distance_geo",
    f"""with d as (select t.cell, min(sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y))) as d from {GRID_ID} t cross join oof p group by t.cell)
select cell, round(d, 6) as d, round(d / (select avg(d) from d where d > 0), 6) as ratio from d""",
    ("grid", "oof"),
)
def q_nn_geo(spark, sf):
    return U.coord_di(_grid(spark, sf), oof(spark, sf)).select("cell", r6("nn_dist", "d"), r6("di", "ratio"))


@query(
    "nearest_line_distance",
    """with s as (select *, x2 - x1 as dx, y2 - y1 as dy from segments),
p as (select a.sample_id, a.x, a.y, s.*, case when s.dx * s.dx + s.dy * s.dy > 0
  then least(greatest(((a.x - s.x1) * s.dx + (a.y - s.y1) * s.dy) / (s.dx * s.dx + s.dy * s.dy), 0), 1) else 0 end as t from samples a cross join s)
select sample_id, round(min(sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy)))), 6) as dist from p group by sample_id""",
    ("samples", "segments"),
)
def q_line(spark, sf):
    return nearest_line_distance(spread(samples(spark, sf)), segments(spark, sf)).select("sample_id", r6("dist", "dist"))


FEATURE_NN = """with d as (select a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as d
  from embeddings a cross join embeddings b where a.vec_id <> b.vec_id)
select vec_id, round(min(d), 6) as nn_dist from d group by vec_id"""


@query("nn_distance_features", FEATURE_NN)
def q_nn_features(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = nearest_distance(e, e, "nn_dist", target_coords=F.col("v"), item_coords=F.col("v"), item_id="vec_id", self_id="vec_id")
    return j.select("vec_id", r6("nn_dist", "nn_dist"))


@query("nn_distance_features_units", FEATURE_NN)
def q_nn_features_units(spark, sf):
    """The same in the layout for tables above the broadcast bound."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = nearest_distance(e, e, "nn_dist", target_coords=F.col("v"), item_coords=F.col("v"), item_id="vec_id", self_id="vec_id", broadcast_rows=0)
    return j.select("vec_id", r6("nn_dist", "nn_dist"))


@query(
    "conformal_global_quantile",
    """with n as (select count(*) as n from oof), o as (select *, row_number() over (order by abs_residual) as rn from oof),
q as (select o.abs_residual as q from o, n where o.rn = least(greatest(ceil((n.n + 1) * 0.9::double), 1), n.n))
select n.n as n, round(q.q, 6) as q,
  round(avg(case when y_true >= pred - q.q and y_true <= pred + q.q then 1.0::double else 0.0::double end), 6) as picp, round(avg(2 * q.q), 6) as width,
  round(avg((pred + q.q) - (pred - q.q) + 20.0::double * greatest(pred - q.q - y_true, 0) + 20.0::double * greatest(y_true - (pred + q.q), 0)), 6) as interval_score
from oof, q, n group by n.n, q.q""",
    ("oof",),
)
def q_global(spark, sf):
    return U.conformal_global_quantile(oof(spark, sf)).select(
        "n", r6("q", "q"), r6("picp", "picp"), r6("width", "width"), r6("interval_score", "interval_score")
    )


@query(
    "weighted_quantile",
    """with w as (select l_suppkey as k, l_extendedprice as v, l_quantity as w from lineitem where l_quantity > 0),
c as (select k, v, sum(w) over (partition by k order by v, w rows between unbounded preceding and current row) as cum, sum(w) over (partition by k) as tot from w)
select k, round(min(v), 6) as q90 from c where cum >= 0.9::double * tot group by k""",
)
def q_wq(spark, sf):
    return grouped_weighted_quantile(
        table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", 0.9
    ).select(F.col("l_suppkey").alias("k"), r6("q", "q90"))


def grouped_weighted_quantile(df, by, value, weight, q):
    """Per-group weighted quantile; equal values merge first, then a running weight per group."""
    p = df.filter((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(by, value).agg(F.sum(weight).alias("w"))
    tot = p.groupBy(by).agg(F.sum("w").alias("tot"))
    c = running(p, [by], [value], F.col("w"), "sum", "cum").join(tot, by)
    return c.filter(F.col("cum") >= F.lit(float(q)) * F.col("tot")).groupBy(by).agg(F.min(value).alias("q"))


@query(
    "cumulative_weight",
    """select l_suppkey, l_partkey, round(sum(w) over (partition by l_suppkey order by l_partkey rows between unbounded preceding and current row), 6) as cum
from (select l_suppkey, l_partkey, sum(l_quantity) as w from lineitem group by 1, 2)""",
)
def q_cumw(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    return running(p, ["l_suppkey"], ["l_partkey"], F.col("w"), "sum", "cum").select("l_suppkey", "l_partkey", r6("cum", "cum"))


@query(
    "local_qhat_idw",
    f"""with nn as materialized (select * from ({NN.format(id="cell", targets=GRID_ID)}) where rn <= 48),
n as (select count(*) as n from oof), o as (select *, row_number() over (order by abs_residual) as rn from oof),
g as (select o.abs_residual as q from o, n where o.rn = least(greatest(ceil((n.n + 1) * 0.9::double), 1), n.n)),
ww as (select tid, r, 1.0::double / pow(greatest(d, 1.0::double), 1.5::double) as w from nn),
cw as (select tid, r, sum(w) over (partition by tid order by r, w rows between unbounded preceding and current row) as cum, sum(w) over (partition by tid) as tot from ww),
lq as (select tid, min(r) as q from cw where cum >= 0.9::double * tot group by tid)
select tid as cell, round(least(greatest(0.65::double * lq.q + 0.35::double * g.q, g.q * 0.65::double), g.q * 1.8::double), 6) as half_width from lq, g""",
    ("grid", "oof"),
)
def q_idw(spark, sf):
    return U.local_qhat_idw(_grid(spark, sf), oof(spark, sf)).select("cell", r6("half_width", "half_width"))


IV = f"""{qhat_ctes('oof', 'sample_id')},
iv as materialized (select o.sample_id, o.x, o.y, o.y_true, o.pred, o.abs_residual, q.qhat, o.pred - q.qhat as lo, o.pred + q.qhat as hi, 2.0::double * q.qhat as width,
  case when o.y_true >= o.pred - q.qhat and o.y_true <= o.pred + q.qhat then 1 else 0 end as covered from oof o join qh q on o.sample_id = q.tid)"""


def _sample_intervals(spark, sf):
    o = oof(spark, sf)
    return U.prediction_intervals(U.local_qhat(o, o))


@query(
    "prediction_intervals",
    f"with {IV} select sample_id, round(lo, 6) as interval_lower, round(hi, 6) as interval_upper, round(width, 6) as interval_width, covered from iv",
    ("oof",),
)
def q_intervals(spark, sf):
    return _sample_intervals(spark, sf).select(
        "sample_id", r6("interval_lower", "interval_lower"), r6("interval_upper", "interval_upper"), r6("interval_width", "interval_width"), "covered"
    )


CCB = """e as (select list_distinct(quantile_cont(width, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) as e from iv),
bins as (select greatest(len(list_filter(e.e, lambda z: z < iv.width)), 1) as bin, count(*) as n, avg(covered::double) as coverage from iv, e group by 1)"""


@query(
    "coverage_by_width_bin",
    f"with {IV}, {CCB} select bin, n, round(coverage, 6) as coverage from bins",
    ("oof",),
)
def q_ccb(spark, sf):
    iv = write_and_read(_sample_intervals(spark, sf), "intervals")
    return U.coverage_by_width_bin(iv).select("bin", "n", r6("coverage", "coverage"))


IM = f"""{IV}, {CCB},
m as (select count(*) as n, avg(covered::double) as picp, avg(width) as mpiw, avg(width) / (max(y_true) - min(y_true)) as nmpiw,
  (select avg(abs(coverage - 0.9::double)) from bins) as ccb,
  avg((hi - lo) + 20.0::double * greatest(lo - y_true, 0) + 20.0::double * greatest(y_true - hi, 0)) as interval_score, quantile_cont(width, 0.5) as median_width from iv)"""
IM_COLS = "n, round(picp, 6) as picp, round(mpiw, 6) as mpiw, round(nmpiw, 6) as nmpiw, round(ccb, 6) as ccb, round(interval_score, 6) as interval_score, round(median_width, 6) as median_width"


def _im_cols(*more):
    return ["n", *[r6(c, c) for c in ("picp", "mpiw", "nmpiw", "ccb", "interval_score", "median_width", *more)]]


@query("interval_metrics", f"with {IM} select {IM_COLS} from m", ("oof",))
def q_im(spark, sf):
    iv = write_and_read(_sample_intervals(spark, sf), "intervals")
    return U.interval_metrics(iv).select(*_im_cols())


SCORE = "-interval_score - 4.0::double * abs(picp - 0.9::double) - ccb - 0.2::double * nmpiw"


@query("composite_score", f"with {IM} select {IM_COLS}, round({SCORE}, 6) as composite_score from m", ("oof",))
def q_composite(spark, sf):
    iv = write_and_read(_sample_intervals(spark, sf), "intervals")
    return U.composite_score(U.interval_metrics(iv)).select(*_im_cols("composite_score"))


def _search_sql() -> str:
    parts = ["sets(name, alpha, k, scale, min_bw) as (values " + ", ".join(f"('{n}', {a}::double, {k}, {s}::double, {b}::double)" for n, a, k, s, b in U.PARAM_SETS) + ")"]
    parts.append(f"nn as materialized (select * from ({NN.format(id='sample_id', targets='oof')}) where rn <= 80)")
    parts.append("""bw as (select s.name, s.alpha, n.tid, greatest(any_value(s.min_bw), max(n.d) * any_value(s.scale)) as bw, any_value(s.k) as k from nn n join sets s on n.rn <= s.k group by 1, 2, 3),
ww as (select b.name, b.alpha, n.tid, n.r, exp(-0.5::double * (n.d / b.bw) * (n.d / b.bw)) as w from nn n join bw b on n.tid = b.tid and n.rn <= b.k),
cw as (select name, alpha, tid, r, sum(w) over (partition by name, tid order by r, w rows between unbounded preceding and current row) as cum, sum(w) over (partition by name, tid) as tot from ww where w > 0),
qh as (select name, alpha, tid, min(r) as qhat from cw where cum >= (1.0::double - alpha) * tot group by 1, 2, 3),
iv as materialized (select q.name, q.alpha, o.y_true, o.pred - q.qhat as lo, o.pred + q.qhat as hi, 2.0::double * q.qhat as width,
  case when o.y_true >= o.pred - q.qhat and o.y_true <= o.pred + q.qhat then 1 else 0 end as covered from oof o join qh q on o.sample_id = q.tid),
e as (select name, list_distinct(quantile_cont(width, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) as e from iv group by name),
bins as (select iv.name, iv.alpha, greatest(len(list_filter(e.e, lambda z: z < iv.width)), 1) as bin, avg(covered::double) as coverage from iv join e on iv.name = e.name group by 1, 2, 3),
c as (select name, avg(abs(coverage - (1.0::double - alpha))) as ccb from bins group by name),
m as (select iv.name, any_value(iv.alpha) as alpha, count(*) as n, avg(covered::double) as picp, avg(width) as mpiw, avg(width) / (max(y_true) - min(y_true)) as nmpiw, any_value(c.ccb) as ccb,
  avg((hi - lo) + 2.0::double / iv.alpha * greatest(lo - y_true, 0) + 2.0::double / iv.alpha * greatest(y_true - hi, 0)) as interval_score, quantile_cont(width, 0.5) as median_width
  from iv join c on iv.name = c.name group by iv.name)""")
    return "with " + ",\n".join(parts)


@query(
    "gcp_param_search",
    f"""{_search_sql()},
s as (select *, -interval_score - 4.0::double * abs(picp - (1.0::double - alpha)) - ccb - 0.2::double * nmpiw as composite_score from m)
select name, {IM_COLS}, round(composite_score, 6) as composite_score, row_number() over (order by composite_score desc, name) = 1 as best from s""",
    ("oof",),
)
def q_search(spark, sf):
    m = U.gcp_param_search(oof(spark, sf))
    best = m.select(F.max_by("name", F.struct("composite_score"))).scalar()  # five rows
    return m.select("name", *_im_cols("composite_score"), (F.col("name") == best).alias("best"))


# ---------------------------------------------------------------- grid side

CELLS = f"""cells as materialized (select g.cell, g.x, g.y, (select round(avg(y_true), 6) from oof) as pred from {GRID_ID} g)"""


def _cells(spark, sf):
    mean = oof(spark, sf).select(F.round(F.avg("y_true"), 6)).scalar()
    return _grid(spark, sf).select("cell", "x", "y").withColumn("pred", mean)


@query(
    "grid_intervals",
    f"""with {CELLS}, {qhat_ctes('cells', 'cell')}
select c.cell, round(pred - qhat, 6) as interval_lower, round(pred + qhat, 6) as interval_upper, round(2.0::double * qhat, 6) as interval_width from cells c join qh on c.cell = qh.tid""",
    ("grid", "oof"),
)
def q_grid_iv(spark, sf):
    iv = U.grid_intervals(_cells(spark, sf), oof(spark, sf))
    return iv.select("cell", r6("interval_lower", "interval_lower"), r6("interval_upper", "interval_upper"), r6("interval_width", "interval_width"))


FEATURES = ["c_size", "c_cyc", "c_zero"]
IMPORTANCE = {"c_size": 0.5, "c_cyc": 0.3, "c_zero": 0.2}
_W = U.feature_weights(FEATURES, IMPORTANCE)
ZSPACE = f"""st as (select avg(c_size) as m1, stddev_pop(c_size) as s1, avg(c_cyc) as m2, stddev_pop(c_cyc) as s2, avg(c_zero) as m3, stddev_pop(c_zero) as s3 from samples),
z as materialized (select sample_id, coalesce((c_size - m1) / s1, 0) * {_W['c_size']!r}::double as z1, coalesce((c_cyc - m2) / s2, 0) * {_W['c_cyc']!r}::double as z2,
  coalesce((c_zero - m3) / s3, 0) * {_W['c_zero']!r}::double as z3 from samples, st),
nn as materialized (select a.sample_id, min(sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2) + (a.z3 - b.z3) * (a.z3 - b.z3))) as d
  from z a join z b on a.sample_id <> b.sample_id group by 1),
tdi as (select sample_id, d / (select coalesce(avg(d), 1) from nn where d > 0) as di, (select coalesce(avg(d), 1) from nn where d > 0) as mean_nn from nn),
tq as (select quantile_cont(di, [0.25, 0.75, 0.95]) as q from tdi),
thr as (select coalesce(max(case when di <= q[2] + 1.5::double * (q[2] - q[1]) then di end), max(q[3])) as threshold from tdi, tq)"""


@query(
    "aoa_train_di",
    f"with {ZSPACE} select sample_id, round(di, 6) as di from tdi",
    ("samples",),
)
def q_tdi(spark, sf):
    return U.aoa_train_di(samples(spark, sf), FEATURES, IMPORTANCE).select("sample_id", r6("di", "di"))


@query("aoa_threshold", f"with {ZSPACE} select round(threshold, 6) as threshold from thr", ("samples",))
def q_thr(spark, sf):
    return U.aoa_threshold(U.aoa_train_di(samples(spark, sf), FEATURES, IMPORTANCE)).select(r6("threshold", "threshold"))


# Covariates on the map come from the orders table: one target row per customer.
COVCELLS = """covcells as (select o_custkey as cell, (avg(o_totalprice) / 5000.0::double) as c_size, cast(count(*) as double) * 4.0::double as c_cyc, cast(o_custkey % 5 as double) as c_zero from orders group by o_custkey)"""


def _covcells(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(
        (F.avg("o_totalprice") / 5000.0).alias("c_size"),
        (F.count("*").cast("double") * 4.0).alias("c_cyc"),
    ).withColumn("c_zero", (F.col("cell") % 5).cast("double"))


GDI = f"""{ZSPACE}, {COVCELLS},
zc as (select cell, coalesce((c_size - m1) / s1, 0) * {_W['c_size']!r}::double as z1, coalesce((c_cyc - m2) / s2, 0) * {_W['c_cyc']!r}::double as z2,
  coalesce((c_zero - m3) / s3, 0) * {_W['c_zero']!r}::double as z3 from covcells, st),
gdi as materialized (select c.cell, min(sqrt((c.z1 - b.z1) * (c.z1 - b.z1) + (c.z2 - b.z2) * (c.z2 - b.z2) + (c.z3 - b.z3) * (c.z3 - b.z3))) / (select any_value(mean_nn) from tdi) as di from zc c cross join z b group by c.cell)"""


@query("aoa_grid_di", f"with {GDI} select cell, round(di, 6) as di from gdi", ("samples",))
def q_gdi(spark, sf):
    return U.aoa_grid_di(_covcells(spark, sf), samples(spark, sf), FEATURES, IMPORTANCE).select("cell", r6("di", "di"))


@query("aoa_grid_di_units", f"with {GDI} select cell, round(di, 6) as di from gdi", ("samples",))
def q_gdi_units(spark, sf):
    """Dissimilarity of map cells in the layout for samples above the broadcast bound."""
    return U.aoa_grid_di(_covcells(spark, sf), samples(spark, sf), FEATURES, IMPORTANCE, broadcast_rows=0).select("cell", r6("di", "di"))


@query(
    "aoa_inside",
    f"with {GDI} select cell, case when di <= threshold then 1 else 0 end as inside from gdi, thr",
    ("samples",),
)
def q_inside(spark, sf):
    s = samples(spark, sf)
    tdi = U.aoa_train_di(s, FEATURES, IMPORTANCE)
    g = U.aoa_grid_di(_covcells(spark, sf), s, FEATURES, IMPORTANCE, train_di=tdi)
    thr = U.aoa_threshold(tdi).select("threshold").scalar()
    return g.select("cell", (F.col("di") <= thr).cast("int").alias("inside"))


COORD = f"""{CELLS},
cd as (select c.cell, min(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))) as d from cells c cross join oof p group by 1),
cdi as (select cell, d / (select avg(d) from cd where d > 0) as di from cd),
sd as (select a.sample_id, min(sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y))) as d from oof a join oof p on a.sample_id <> p.sample_id group by 1),
sthr as (select quantile_cont(d / (select avg(d) from sd where d > 0), 0.95) as t from sd)"""


def _coord_inside(o, cells):
    """Cells with coordinate DI and the flag against the 95th percentile of the samples' own DI."""
    g = U.coord_di(cells, o)
    nn = write_and_read(nearest_distance(o, o, "d", self_id="sample_id").select("d"), "own-di")
    mean = nn.filter(F.col("d") > 0).select(F.coalesce(F.avg("d"), F.lit(1.0))).scalar()
    thr = exact_quantile_scalar(nn.select((F.col("d") / mean).alias("di")), "di", [U.AOA_OUTLIER_QUANTILE])
    return g.withColumn("__t", thr).withColumn("inside", (F.col("di") <= F.col("__t")[0]).cast("int")).drop("__t")


@query(
    "aoa_grid_di_coord",
    f"with {COORD} select cell, round(di, 6) as di, case when di <= t then 1 else 0 end as inside from cdi, sthr",
    ("grid", "oof"),
)
def q_coord(spark, sf):
    return _coord_inside(oof(spark, sf), _cells(spark, sf)).select("cell", r6("di", "di"), "inside")


RISK = f"""{COORD}, {qhat_ctes('cells', 'cell')},
gi as materialized (select c.cell, 2.0::double * qhat as width, case when d.di <= s.t then 1 else 0 end as inside from cells c join qh on c.cell = qh.tid join cdi d on d.cell = c.cell cross join sthr s),
wt as (select quantile_cont(width, 0.75) as t from gi),
rk as materialized (select cell, inside, width, case when width <= t and inside = 1 then 1 when width > t and inside = 1 then 2 when width > t then 3 else 4 end as risk from gi, wt)"""


def risk_cells(spark, sf):
    """Every map cell with interval, DI, inside flag and risk class."""
    o = write_and_read(oof(spark, sf), "calibration")
    iv = U.grid_intervals(_cells(spark, sf), o)
    cells = write_and_read(_coord_inside(o, iv), "risk-cells")
    return U.risk_class(cells)


@query("risk_class", f"with {RISK} select cell, risk from rk", ("grid", "oof"))
def q_risk(spark, sf):
    return risk_cells(spark, sf).select("cell", "risk")


@query(
    "risk_class_counts",
    f"with {RISK} select risk, count(*) as n_cells, round(count(*) / (select count(*) from rk)::double, 6) as share from rk group by risk",
    ("grid", "oof"),
)
def q_risk_counts(spark, sf):
    return U.risk_class_counts(risk_cells(spark, sf)).select("risk", "n_cells", r6("share", "share"))


@query(
    "aoa_feature_weights",
    """with f as (select l_returnflag || l_linestatus as feature, greatest(sum(l_quantity * l_discount), 0) as imp from lineitem group by 1)
select feature, round(sqrt(imp / (select avg(imp) from f)), 6) as weight from f""",
)
def q_weights(spark, sf):
    imp = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(
        F.sum(F.col("l_quantity") * F.col("l_discount")).alias("importance")
    )
    return importance_weights(imp).select("feature", r6("weight", "weight"))


def importance_weights(imp):
    """Table form of the weights: sqrt(importance / mean), ones when nothing is positive."""
    pos = F.greatest(F.coalesce("importance", F.lit(0.0)), F.lit(0.0))
    m = imp.select(F.avg(pos)).scalar()
    return imp.withColumn("__m", m).withColumn("weight", F.when(F.col("__m") > 0, F.sqrt(pos / F.col("__m"))).otherwise(F.lit(1.0))).drop("__m")


@query(
    "standardize_stats",
    """select round(avg(c_size), 6) as c_size__mean, round(stddev_pop(c_size), 6) as c_size__std, round(avg(c_cyc), 6) as c_cyc__mean, round(stddev_pop(c_cyc), 6) as c_cyc__std,
round(avg(c_zero), 6) as c_zero__mean, round(stddev_pop(c_zero), 6) as c_zero__std from samples""",
    ("samples",),
)
def q_std(spark, sf):
    st = U.standardize_stats(samples(spark, sf), FEATURES)
    return st.select(*[r6(c, c) for c in st.columns])


@query(
    "sample_interval_audit",
    f"""with {IV}, {ZSPACE.replace('nn as', 'fn as').replace('from nn', 'from fn')}
select iv.sample_id, x, y, y_true, pred, abs_residual, round(qhat, 6) as qhat, round(lo, 6) as interval_lower, round(hi, 6) as interval_upper, round(width, 6) as interval_width, covered,
  round(di, 6) as aoa_di, case when di <= threshold then 1 else 0 end as aoa_inside from iv join tdi on iv.sample_id = tdi.sample_id cross join thr""",
    ("oof",),
)
def q_audit(spark, sf):
    tdi = U.aoa_train_di(samples(spark, sf), FEATURES, IMPORTANCE)
    thr = U.aoa_threshold(tdi).select("threshold").scalar()
    a = _sample_intervals(spark, sf).join(tdi.select("sample_id", "di"), "sample_id")
    keep = ["sample_id", "x", "y", "y_true", "pred", "abs_residual"]
    return a.withColumn("__t", thr).select(
        *keep, *[r6(c, c) for c in ("qhat", "interval_lower", "interval_upper", "interval_width")], "covered",
        r6("di", "aoa_di"), (F.col("di") <= F.col("__t")).cast("int").alias("aoa_inside"),
    )


@query(
    "uncertainty_summary",
    f"""with {IV}, {CCB}, {RISK.replace('nn as', 'gnn as').replace('from nn', 'from gnn').replace('bw as (', 'gbw as (').replace('join bw', 'join gbw').replace('ww as', 'gww as').replace('from ww', 'from gww').replace('cw as', 'gcw as').replace('from cw', 'from gcw').replace('qh as', 'gqh as').replace('join qh on c.cell = qh.tid', 'join gqh on c.cell = gqh.tid')}
select (select round(avg(covered::double), 6) from iv) as picp, (select round(avg(width), 6) from iv) as mpiw, count(*) as valid_cells, cast(sum(inside) as bigint) as inside_cells,
  round(avg(inside), 6) as inside_ratio, count(*) filter (risk = 1) as risk_1, count(*) filter (risk = 2) as risk_2, count(*) filter (risk = 3) as risk_3, count(*) filter (risk = 4) as risk_4 from rk""",
    ("grid", "oof"),
)
def q_summary(spark, sf):
    m = _sample_intervals(spark, sf).agg(F.struct(F.avg(F.col("covered").cast("double")).alias("picp"), F.avg("interval_width").alias("mpiw")))
    g = risk_cells(spark, sf).agg(
        F.count("*").alias("valid_cells"),
        F.sum("inside").alias("inside_cells"),
        r6(F.avg("inside"), "inside_ratio"),
        *[F.count_if(F.col("risk") == i).alias(f"risk_{i}") for i in (1, 2, 3, 4)],
    )
    s = g.withColumn("__m", m.scalar())
    return s.select(r6("__m.picp", "picp"), r6("__m.mpiw", "mpiw"), *g.columns)
