"""Queries: validation splits, variograms, kriging, forests and the model table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import fixed_values as V
from loamgrid.operators import kriging as K
from loamgrid.operators import modelling as M
from loamgrid.operators import raster as R
from loamgrid.operators import validation as W
from loamgrid.operators.aggregates import fold_summary, regression_metrics
from loamgrid.operators.ordering import exact_quantiles
from loamgrid.operators.schema import coordinate_features, unpivot
from loamgrid.plans.registry import query
from loamgrid.plans.views import GRID_TOP, areas, block_of, grid, layout, oof, raster_cells, samples, table, wide
from loamgrid.session import write_and_read

r6 = lambda c, n: F.round(c, 6).alias(n)
FEATS = ["c_size", "c_cyc", "c_zero", "f_qty", "f_disc", "f_tax", "f_price"]
SEVEN = list(range(1, 8))
KRIG = {"model": "spherical", "nlags": 6, "nearest": 16}


# ---------------------------------------------------------------- blocks and splits


@query(
    "spatial_blocks_equal",
    "with b as (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from samples) select sample_id, cast(least(floor((lat - y0) / ((y1 - y0) / 5)), 4) * 5 + least(floor((lon - x0) / ((x1 - x0) / 5)), 4) as int) as block from samples, b",
    ("samples",),
)
def q_equal(spark, sf):
    return W.blocks_equal(samples(spark, sf)).select("sample_id", "block")


QB = """qe as (select list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) as qx, list_distinct(quantile_cont(y, [0.2, 0.4, 0.6, 0.8])) as qy from samples),
qb as (select sample_id, x, y, som, cast(len(list_filter(qy, lambda e: e <= y)) * 5 + len(list_filter(qx, lambda e: e <= x)) as int) as block from samples, qe)"""


@query("spatial_blocks_quantile", f"with {QB} select sample_id, block from qb", ("samples",))
def q_quant(spark, sf):
    return W.blocks_quantile(samples(spark, sf)).select("sample_id", "block")


def _blocked(spark, sf):
    return samples(spark, sf).withColumn("block", block_of())


SP = """sp as (select seed, block, case when row_number() over (partition by seed order by md5(concat(seed, ':', block)), block) <= ceil(0.3::double * count(*) over (partition by seed)) then 'test' else 'train' end as role
from (select distinct block from oof) cross join (select unnest(range(1, {n})) as seed))"""


@query("group_shuffle_split", f"with {SP.format(n=2)} select o.sample_id, s.block, role from oof o join sp s on o.block = s.block", ("oof",))
def q_gss(spark, sf):
    return W.split_rows(_blocked(spark, sf), "block", [1]).select("sample_id", "block", "role")


@query(
    "repeated_group_holdout",
    f"with {SP.format(n=8)} select count(*) as pooled_test, count(distinct sample_id) as unique_test, round(count(distinct sample_id) / (select count(*) from oof)::double, 6) as ratio from oof o join sp s on o.block = s.block where role = 'test'",
    ("oof",),
)
def q_rgh(spark, sf):
    b = _blocked(spark, sf).select("sample_id", "block")
    t = W.split_rows(b, "block", list(range(1, 8))).filter("role = 'test'")
    per = t.groupBy("sample_id").agg(F.count("*").alias("m"))
    n = b.select(F.count("*")).scalar()
    return per.agg(F.sum("m").alias("pooled_test"), F.count("*").alias("unique_test"), r6(F.count("*") / n, "ratio"))


@query(
    "group_kfold",
    """with recursive g as (select block, count(*) as n, row_number() over (order by count(*) desc, block) as rn from oof group by 1),
f(i, loads, block, fold) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], null::int, null::int union all
 select rn, list_transform(loads, lambda v, j: case when j = list_position(loads, list_min(loads)) then v + g.n else v end)::bigint[], g.block::int, cast(list_position(loads, list_min(loads)) - 1 as int) from f join g on g.rn = f.i + 1)
select o.sample_id, f.fold from oof o join f on o.block = f.block""",
    ("oof",),
)
def q_gkf(spark, sf):
    b = _blocked(spark, sf)
    return b.join(W.group_kfold(b, "block"), "block").select("sample_id", "fold")


@query(
    "random_holdout",
    "select o_orderkey, case when row_number() over (order by md5(concat('42:', o_orderkey)), o_orderkey) <= ceil(0.3::double * count(*) over ()) then 'test' else 'train' end as role from orders",
)
def q_rh(spark, sf):
    return W.random_holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("random_kfold", "select o_orderkey, cast(ntile(5) over (order by md5(concat('42:', o_orderkey)), o_orderkey) as int) as fold from orders")
def q_rk(spark, sf):
    return W.random_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("split_audit", f"with {SP.format(n=4)} select seed as fold, s.block, role, count(*) as n, min(sample_id) as first_row from oof o join sp s on o.block = s.block group by 1, 2, 3", ("oof",))
def q_audit(spark, sf):
    s = W.split_rows(_blocked(spark, sf), "block", [1, 2, 3])
    return s.groupBy(F.col("seed").alias("fold"), "block", "role").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_row"))


OOFT = f"""{SP.format(n=6)}, m as (select seed, sum(y_true) / count(*) as p from oof o join sp s on o.block = s.block where role = 'train' group by 1),
t as (select o.sample_id, s.seed, o.x, o.y, o.y_true, m.p from oof o join sp s on o.block = s.block join m on m.seed = s.seed where role = 'test')"""


@query(
    "oof_table",
    f"with {OOFT} select sample_id, count(*) as folds, min(seed) as first_fold, round(avg(p), 5) as pred, round(abs(any_value(y_true) - avg(p)), 5) as abs_residual from t group by 1",
    ("oof",),
)
def q_ooft(spark, sf):
    return M.oof_table(mean_predictor(oof(spark, sf).select("sample_id", "block", "x", "y", "y_true"), [1, 2, 3, 4, 5]).withColumnRenamed("seed", "fold")).select(
        "sample_id", "folds", "first_fold", F.round("pred", 5).alias("pred"), F.round("abs_residual", 5).alias("abs_residual")
    )


def mean_predictor(df, seeds):
    """Test rows of every split with the mean of its train rows: the simplest true holdout prediction."""
    g = df.groupBy("block").agg(F.sum("y_true").alias("s"), F.count("*").alias("n"))
    roles = W.group_split(df, "block", seeds)
    m = roles.filter("role = 'train'").join(g, "block").groupBy("seed").agg((F.sum("s") / F.sum("n")).alias("pred"))
    return df.join(roles.filter("role = 'test'"), "block").join(m, "seed")


@query(
    "trial_table",
    "with c as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as shrink), g as (select avg(y_true) as m from oof) select shrink, count(*) as n, round(sqrt(avg((shrink * pred + (1 - shrink) * m - y_true) * (shrink * pred + (1 - shrink) * m - y_true))), 6) as rmse, round(avg(abs(shrink * pred + (1 - shrink) * m - y_true)), 6) as mae from oof, c, g group by 1",
    ("oof",),
)
def q_trials(spark, sf):
    o = oof(spark, sf)
    g = o.select(F.avg("y_true")).scalar()
    c = o.withColumn("m", g).withColumn("shrink", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    p = c.select("shrink", "y_true", (F.col("shrink") * F.col("pred") + (1 - F.col("shrink")) * F.col("m")).alias("pred"))
    return regression_metrics(p, by=["shrink"]).select("shrink", "n", r6("rmse", "rmse"), r6("mae", "mae"))


# ---------------------------------------------------------------- variograms and kriging


def _points(spark, sf):
    """Residuals of the block-mean predictor as kriging points."""
    return oof(spark, sf).select(F.col("sample_id").alias("id"), "x", "y", F.round(F.col("y_true") - F.col("pred"), 6).alias("z"))


PTS = "pts as materialized (select sample_id as id, x, y, round(y_true - pred, 6) as z from oof)"
PAIRS = "pr as materialized (select sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, 0.5::double * (a.z - b.z) * (a.z - b.z) as g from pts a join pts b on a.id < b.id)"


@query(
    "pair_join_lags",
    f"with {PTS}, {PAIRS} select cast(floor(d / 2000) as int) as lag, count(*) as pairs, round(avg(d), 4) as mean_dist, round(avg(g), 6) as gamma from pr where d < 20000 group by 1",
    ("oof",),
)
def q_pairs(spark, sf):
    return K.lag_pairs(_points(spark, sf), 2000.0, 20000.0).select("lag", "pairs", F.round("mean_dist", 4).alias("mean_dist"), r6("gamma", "gamma"))


VB = f"""{PTS}, {PAIRS}, mm as (select min(d) as lo, max(d) as hi from pr), vb as materialized (select least(cast(floor((d - lo) / ((hi - lo) / 6)) as int), 5) as lag, count(*) as pairs, avg(d) as mean_dist, avg(g) as gamma from pr, mm group by 1)"""


@query("variogram_bins", f"with {VB} select lag, pairs, round(mean_dist, 4) as mean_dist, round(gamma, 6) as gamma from vb", ("oof",))
def q_vb(spark, sf):
    return K.variogram_bins(_points(spark, sf), 6).select("lag", "pairs", F.round("mean_dist", 4).alias("mean_dist"), r6("gamma", "gamma"))


def _fit_sql(weight):
    """The closed-form fit: sums per candidate, the free optimum or the best of four edges, then the least error."""
    within = lambda v, hi: f"least(greatest(coalesce({v}, 0.0::double), 0.0::double), {hi})"
    return f"""with {VB}, top as (select max(gamma) as gmax, max(mean_dist) as dmax, min(mean_dist) as dmin from vb), b as (select mean_dist as h, gamma as g, {weight} as w from vb, top),
c as (select model, i, case when model in ('linear', 'power') then dmax else dmax * i / 400.0::double end as rng, 1.999::double * i / 400.0::double as ex, gmax, gmax * factor as top
 from top, (values ('spherical', 1, 10.0::double), ('exponential', 1, 10.0::double), ('gaussian', 1, 10.0::double), ('linear', 400, 1e9::double), ('power', 1, 1e9::double)) m(model, first, factor), unnest(range(1, 401)) r(i) where i >= first),
f as (select model, i, rng, ex, gmax, top, g, w, case model when 'spherical' then case when h <= rng then 1.5::double * (h / rng) - 0.5::double * pow(h / rng, 3) else 1.0::double end when 'exponential' then 1 - exp(-3.0::double * h / rng) when 'gaussian' then 1 - exp(-pow(1.75::double * h / rng, 2)) when 'linear' then h / rng else pow(h / rng, ex) end as f from c, b),
s as (select model, i, rng, ex, gmax, top, sum(w) as sw, sum(w * f) as sf, sum(w * f * f) as sff, sum(w * g) as sg, sum(w * f * g) as sfg from f group by all),
d as (select *, case when sw * sff - sf * sf > 1e-9::double * sw * sff then (sw * sfg - sf * sg) / (sw * sff - sf * sf) end as fr from s),
o as (select model, i, rng, ex, gmax, 0 as edge, (sg - fr * sf) / sw as nugget, fr as psill from d where (sg - fr * sf) / sw between 0 and gmax and fr between 0 and top
 union all select model, i, rng, ex, gmax, 1, 0, {within("sfg / sff", "top")} from d union all select model, i, rng, ex, gmax, 2, gmax, {within("(sfg - gmax * sf) / sff", "top")} from d
 union all select model, i, rng, ex, gmax, 3, {within("sg / sw", "gmax")}, 0 from d union all select model, i, rng, ex, gmax, 4, {within("(sg - top * sf) / sw", "gmax")}, top from d),
e as (select o.model, o.i, o.rng, o.ex, o.gmax, edge, nugget, psill, sum(w * pow(nugget + psill * f - g, 2)) as sse from o join f on o.model = f.model and o.i = f.i group by all)
select model, round(nugget, 5) as nugget, round(psill, 5) as psill, round(rng, 3) as "range", case when model = 'power' then round(ex, 6) end as exponent, round(sse, 4) as sse
from (select *, row_number() over (partition by model order by round(sse / (gmax * gmax), 10), i, edge) as rn from e) where rn = 1"""


def _fit(spark, sf, weighted):
    f = K.variogram_fit(K.variogram_bins(_points(spark, sf), 6), weighted=weighted)
    return f.select("model", F.round("nugget", 5).alias("nugget"), F.round("psill", 5).alias("psill"), F.round("range", 3).alias("range"), r6("exponent", "exponent"), F.round("sse", 4).alias("sse"))


@query("variogram_fit", _fit_sql("1.0::double"), ("oof",))
def q_vf(spark, sf):
    return _fit(spark, sf, False)


@query("variogram_fit_weighted", _fit_sql("1 / (1 + exp(-(2.1972::double / (0.1::double * (dmax - dmin))) * (0.7::double * (dmax - dmin) + dmin - mean_dist)))"), ("oof",))
def q_vfw(spark, sf):
    return _fit(spark, sf, True)


def _vario(points):
    return K.fitted(points)


@query("variogram_quality")
def q_vq(spark, sf):
    p = _points(spark, sf)
    return K.variogram_quality(p, _vario(p)).select("n", r6("q1", "q1"), r6("q2", "q2"), r6("score", "score"))


@query("krige_local")
def q_kl(spark, sf):
    p = _points(spark, sf)
    return K.krige_local(grid(spark, sf), p, _vario(p), 16, item_id="id").select("row", "col", r6("krig", "krig"), r6("krig_var", "krig_var"), "fallback")


@query("rf_residuals", "select sample_id, round(y_true - pred, 6) as residual from oof", ("oof",))
def q_res(spark, sf):
    return oof(spark, sf).select("sample_id", F.round(F.col("y_true") - F.col("pred"), 6).alias("residual"))


# ---------------------------------------------------------------- parameters


@query(
    "aoi_sample_weight",
    "select s.sample_id, case when exists (select 1 from inside i where i.sample_id = s.sample_id) then 3.0::double else 1.0::double end as weight from samples s",
    ("inside",),
)
def q_weight(spark, sf):
    s = samples(spark, sf)
    hit = R.polygon_join(s.select("sample_id", "x", "y"), areas(spark, sf)).select("sample_id").distinct().withColumn("in_aoi", F.lit(True))
    d = s.join(hit, "sample_id", "left").withColumn("in_aoi", F.coalesce("in_aoi", F.lit(False)))
    return M.aoi_sample_weight(d, F.col("in_aoi")).select("sample_id", "weight")


@query(
    "sample_size_defaults",
    "select c_nationkey, n, case when n < 30 then 400 when n < 80 then 600 when n < 200 then 800 else 1000 end as trees, case when n < 30 then 6 when n < 80 then 10 when n < 200 then 16 else 0 end as depth, case when n < 30 then 4 when n < 80 then 3 when n < 200 then 2 else 1 end as leaf from (select c_nationkey, count(*) as n from customer group by 1)",
)
def q_defaults(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return c.select("c_nationkey", "n", M.sample_size_defaults(F.col("n")).alias("p")).select("c_nationkey", "n", "p.trees", "p.depth", "p.leaf")


@query(
    "candidate_space",
    """with n as (select p_type, count(*) as n from part group by 1), e as (select p_type, n, i, row_number() over (partition by p_type order by md5(concat(p_type, ':', i))) as r from n, unnest(range(0, 15360)) t(i))
select p_type, r + 2 as pos, case i % 2 when 0 then 500 else 800 end as trees, case when n >= 300 then case i // 2 % 4 when 0 then 8 when 1 then 14 when 2 then 16 else 0 end else case i // 2 % 4 when 0 then 6 when 1 then 10 when 2 then 14 else 0 end end as depth,
case i // 8 % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 6 end as leaf, case i // 128 % 4 when 0 then 'spherical' when 1 then 'exponential' when 2 then 'gaussian' else 'linear' end as variogram, 4 + 2 * (i // 512 % 5) as nlags, case i // 2560 % 3 when 0 then 16 when 1 then 32 else 64 end as nearest from e where r <= 14
union all select p_type, pos, 1200, 16, 1, 'spherical', 8, pos * 16 from n, (values (1), (2)) v(pos)""",
)
def q_cands(spark, sf):
    s = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return M.candidate_space(s, "p_type", "n").select("p_type", "pos", "trees", "depth", "leaf", "variogram", "nlags", "nearest")


# ---------------------------------------------------------------- forests (no SQL form; invariants are tested)


def _train(spark, sf):
    rows = wide(spark, sf).withColumn("block", block_of())
    return write_and_read(rows.repartition(spark.sparkContext.defaultParallelism, "sample_id"), "train")


@query("rf_trend")
def q_rf(spark, sf):
    t = _train(spark, sf)
    m = M.fit_rfk(t, "som", FEATS)
    return m.predict(t).select("sample_id", r6("trend", "trend"))


@query("rfk_predict")
def q_rfk(spark, sf):
    t = _train(spark, sf)
    m = M.fit_rfk(t, "som", FEATS, krig=KRIG)
    return m.predict(t).select("sample_id", r6("trend", "trend"), r6("krig", "krig"), r6("pred", "pred"))


@query("fit_full")
def q_full(spark, sf):
    m = M.fit_rfk(_train(spark, sf), "som", FEATS, krig=KRIG)
    return m.residuals.select("id", r6("z", "residual"))


@query("feature_importance")
def q_imp(spark, sf):
    m = M.fit_rfk(_train(spark, sf), "som", FEATS)
    return m.importance().orderBy(F.desc("importance"), "feature").select("feature", r6("importance", "importance"))


@query("rank_features_topk")
def q_rank(spark, sf):
    return M.rank_features(_train(spark, sf), "som", FEATS, 6, M.RF_DEFAULT).select("feature", r6("importance", "importance"))


def _metric_cols(df):
    return df.select(*[c if t == "bigint" or c in ("fold", "mode", "params", "best", "candidate", "kriged") else r6(c, c) for c, t in df.dtypes])


@query("run_one_split")
def q_one(spark, sf):
    s = write_and_read(W.split_rows(_train(spark, sf), "block", [1]), "one-split")
    p = write_and_read(M.run_split(s, "som", FEATS, M.RF_DEFAULT, KRIG), "one-pred")
    return _metric_cols(regression_metrics(p, medae=True))


@query("single_holdout")
def q_single(spark, sf):
    cv = M.cross_validate(_train(spark, sf), "som", FEATS, "block", [7], M.RF_DEFAULT)
    return _metric_cols(regression_metrics(cv))


@query("spatial_cv_rf")
def q_cvrf(spark, sf):
    cv = M.cross_validate(_train(spark, sf), "som", FEATS, "block", SEVEN, M.RF_DEFAULT)
    return _metric_cols(regression_metrics(cv, by=["fold"]))


@query("spatial_cv_rfk")
def q_cvrfk(spark, sf):
    cv = M.cross_validate(_train(spark, sf), "som", FEATS, "block", SEVEN, M.RF_DEFAULT, KRIG)
    return fold_summary(regression_metrics(cv, by=["fold"]))


@query("tune_rfk")
def q_tune(spark, sf):
    """All candidates with the trees they name; each is judged on every split by its trend and its kriged residuals."""
    t = _train(spark, sf)
    return _metric_cols(M.tune(t, "som", FEATS, "block", M.candidates(t.agg(F.count("*").alias("n")), "n"), SEVEN))


@query("deployable_vs_diagnostic")
def q_deploy(spark, sf):
    """Pooled metrics of the model on all features over seven splits and on those that a map has over five; the
    deployable one is chosen where its error is no more than a tenth larger."""
    t = _train(spark, sf)
    one = lambda mode, feats, seeds: regression_metrics(M.cross_validate(t, "som", feats, "block", seeds, M.RF_DEFAULT)).withColumn("mode", F.lit(mode))
    both = write_and_read(one("diagnostic", FEATS, SEVEN).unionByName(one("deployable", ["f_qty", "f_disc", "f_tax"], SEVEN[:5])), "modes")
    least = both.select(F.min("rmse")).scalar()
    near = both.select(F.bool_or((F.col("mode") == "deployable") & (F.col("rmse") <= 1.1 * least))).scalar()
    return _metric_cols(both).withColumn("chosen", (F.col("mode") == "deployable") == near)


@query("oof_refits")
def q_oof_refits(spark, sf):
    cv = M.cross_validate(_train(spark, sf), "som", FEATS, "block", list(range(1, 16)), M.RF_DEFAULT)
    return M.oof_table(cv).select("sample_id", "folds", "first_fold", r6("pred", "pred"), r6("abs_residual", "abs_residual"))


def _kfold(spark, sf, labelled, start):
    t = M.folds(labelled(_train(spark, sf)), F.col("fold") - start)
    return _metric_cols(regression_metrics(M.predict_folds(t.drop("fold"), "som", FEATS, list(range(5)), M.RF_DEFAULT), by=["fold"]))


@query("group_kfold_rf")
def q_gkf_rf(spark, sf):
    return _kfold(spark, sf, lambda t: t.join(W.group_kfold(t, "block").withColumnRenamed("block", "__b"), F.col("block").eqNullSafe(F.col("__b"))).drop("__b"), 0)


@query("random_kfold_rf")
def q_rkf_rf(spark, sf):
    return _kfold(spark, sf, lambda t: W.random_kfold(t, "sample_id"), 1)


@query("predict_grid")
def q_pgrid(spark, sf):
    c = raster_cells(spark, sf)
    s = R.sample_at_points(samples(spark, sf), c, ["qty", "disc"], 0.0, GRID_TOP, layout(spark, sf).res)
    m = M.fit_rfk(write_and_read(s, "grid-train"), "som", ["qty", "disc"], krig=KRIG)
    g = grid(spark, sf).join(R.feature_stack(c, ["qty", "disc", "class"]), ["row", "col"], "left")
    return M.predict_grid(m, g, F.col("class") <= 5).select("row", "col", r6("pred", "pred"))


@query("baseline_rf_grid")
def q_base(spark, sf):
    cols = ["coord_lon_norm", "coord_lat_norm", "coord_dist_center", "coord_lon_lat_interaction", "coord_sin_lon", "coord_cos_lat"]
    t = write_and_read(coordinate_features(samples(spark, sf)), "baseline-train")
    m = M.fit_rfk(t, "som", cols, M.RF_BASELINE)
    g = grid(spark, sf).withColumn("lon", 102.8 + F.col("x") / 95000.0).withColumn("lat", 29.9 + F.col("y") / 110000.0)
    return M.predict_grid(m, coordinate_features(g)).select("row", "col", r6("pred", "pred"))


@query(
    "model_table",
    """with p as (select sample_id, lon, lat, som, landcover, cast(floor((180000 - s.y) / (select res from layout)) as int) as r, cast(floor(s.x / (select res from layout)) as int) as c from samples s), v as (select layer, "row", "col", case when layer = 'disc' and ("row" + "col") % 7 = 0 then null else "value" end as v from raster_cells),
j as (select p.sample_id, lon, lat, som, landcover, max(case when layer = 'qty' then v end) as cov_qty, max(case when layer = 'disc' then v end) as cov_disc from p left join v on p.r = v."row" and p.c = v."col" group by all),
m as (select quantile_cont(cov_qty, 0.5) as q, quantile_cont(cov_disc, 0.5) as d from j where som is not null)
select sample_id, round(lon, 6) as lon, round(lat, 6) as lat, som, case when exists (select 1 from inside i where i.sample_id = j.sample_id) then 1 else 0 end as in_aoi, case when cov_qty is null then 1 else 0 end + case when cov_disc is null then 1 else 0 end as missing_n,
round(coalesce(cov_qty, q), 6) as cov_qty, round(coalesce(cov_disc, d), 6) as cov_disc, case when landcover = 1 then 1.0::double else 0.0::double end as class_1 from j, m where (case when cov_qty is null then 1 else 0 end + case when cov_disc is null then 1 else 0 end) / 2.0 <= 0.5""",
    ("samples", "raster_cells", "inside"),
)
def q_model_table(spark, sf):
    c = raster_cells(spark, sf).withColumn("value", F.when((F.col("layer") == "disc") & ((F.col("row") + F.col("col")) % 7 == 0), None).otherwise(F.col("value")))
    return model_table(samples(spark, sf), c, areas(spark, sf), layout(spark, sf).res).select(
        "sample_id", r6("lon", "lon"), r6("lat", "lat"), "som", "in_aoi", "missing_n", r6("cov_qty", "cov_qty"), r6("cov_disc", "cov_disc"), F.col("landcover__class_1").alias("class_1")
    )


def model_table(samples_df, cells, aoi, res, layers=("qty", "disc"), max_missing=0.5):
    """Model-ready rows: sampled layers, area flag, missing counts, one-hot classes, row gate, median fill.

    The gated table is written once and read back: it is the only source of training, and the
    medians and the filled rows come from the same files.
    """
    from loamgrid.operators.gates import filter_valid_core, row_missing
    from loamgrid.operators.schema import one_hot_classes

    s = R.sample_at_points(samples_df, cells, list(layers), 0.0, GRID_TOP, res)
    s = s.select("*", *[F.col(l).alias(f"cov_{l}") for l in layers]).drop(*layers)
    hit = R.polygon_join(samples_df.select("sample_id", "x", "y"), aoi).select("sample_id").distinct().withColumn("in_aoi", F.lit(1))
    covs = [f"cov_{l}" for l in layers]
    n = row_missing(covs)
    t = s.join(hit, "sample_id", "left").withColumn("in_aoi", F.coalesce("in_aoi", F.lit(0))).withColumn("missing_n", n).withColumn("missing_rate", n / len(covs))
    t = one_hot_classes(t.withColumn("landcover", F.col("landcover").cast("double")), "landcover")
    t = write_and_read(filter_valid_core(t).filter(F.col("missing_rate") <= max_missing), "model-table")
    med = exact_quantiles(unpivot(t, covs), "value", [0.5], ["feature"], few=True)
    m = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("q")[0])))).scalar()  # one entry per layer
    return t.withColumn("__m", m).select(*[F.coalesce(c, F.col("__m")[c], F.lit(0.0)).alias(c) if c in covs else F.col(c) for c in t.columns])
