"""Kriging, splits, intervals and forests: brute force and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import kriging as K
from loamgrid.operators import modelling as M
from loamgrid.operators import uncertainty as U
from loamgrid.operators import validation as W
from loamgrid.operators.raster import edge_connected
from loamgrid.plans.views import block_of, oof, samples, wide


def points(n=120, seed=1):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 100, n), r.uniform(0, 100, n)
    return pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "z": np.sin(x / 20) + y / 50 + r.normal(0, 0.1, n)})


V = {"model": "spherical", "nugget": 0.01, "psill": 0.8, "range": 60.0}


def test_kriging_is_exact_at_points_and_equals_the_dense_system(spark):
    p = points()
    df = spark.createDataFrame(p)
    at = K.krige_local(df, df.withColumnRenamed("id", "pid"), V, 16, item_id="pid").collect()
    assert max(abs(r["krig"] - r["z"]) for r in at) < 1e-6
    t = spark.createDataFrame(pd.DataFrame({"x": [10.0, 55.5], "y": [20.0, 71.0]}))
    near = {(r["x"], r["y"]): r["krig"] for r in K.krige_local(t, df, V, len(p), item_id="id").collect()}
    g = lambda h: np.where(h == 0, 0.0, K.gamma_numpy("spherical", h, V["nugget"], V["psill"], V["range"]))
    a = np.ones((121, 121))
    a[:120, :120] = g(np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values))
    a[120, 120] = 0
    for (x, y), v in near.items():
        b = np.append(g(np.hypot(p.x - x, p.y - y)), 1.0)
        want = float(np.linalg.solve(a, b)[:120] @ p.z.values)
        assert abs(v - want) < 1e-6


def test_pair_statistics_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "UNIT", 25)
    p = points(150, 2)
    d = np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)[np.triu_indices(150, 1)]
    g = (0.5 * (p.z.values[:, None] - p.z.values) ** 2)[np.triu_indices(150, 1)]
    df = spark.createDataFrame(p)
    for r in K.lag_pairs(df, 5.0, 30.0).collect():
        m = (d >= 5.0 * r["lag"]) & (d < 5.0 * (r["lag"] + 1))
        assert r["pairs"] == m.sum() and abs(r["gamma"] - g[m].mean()) < 1e-9
    b = K.variogram_bins(df, 6).collect()
    assert sum(r["pairs"] for r in b) == len(d)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("model", K.MODELS)
def test_variogram_fit_finds_the_model_and_no_grid_point_is_better(spark, model, weighted):
    h = np.linspace(5.0, 100.0, 12)
    truth = {"nugget": 0.3, "psill": 2.0, "rng": 60.0 if model in ("spherical", "exponential", "gaussian") else 100.0, "exponent": 1.999 * 0.4}
    for noise in (0.0, 0.2):
        g = K.gamma_numpy(model, h, **truth) + noise * np.sin(7 * h)
        df = spark.createDataFrame(pd.DataFrame({"mean_dist": h, "gamma": g}))
        r = K.variogram_fit(df, [model], weighted=weighted).first()
        got = (r["nugget"], r["psill"], r["range"], r["exponent"] or 1.5)
        if not noise:
            assert np.allclose(got[:3], (truth["nugget"], truth["psill"], truth["rng"]), rtol=1e-6)
        w = 1 / (1 + np.exp(-(2.1972 / 9.5) * (0.7 * 95 + 5 - h))) if weighted else np.ones(12)
        loss = lambda n, s, a, e: float((w * (K.gamma_numpy(model, h, n, s, a, e) - g) ** 2).sum())
        assert abs(loss(*got) - r["sse"]) < 1e-9
        for n in np.linspace(0, g.max(), 12):
            for s in np.linspace(0, 4, 12):
                for t in np.arange(1, 401, 21) / 400:
                    a, e = (100.0, 1.999 * t) if model in ("linear", "power") else (100.0 * t, 1.5)
                    assert loss(n, s, a, e) >= r["sse"] - 1e-8


def test_variogram_fit_of_constant_falling_and_missing_values(spark):
    fit = lambda rows: {r["model"]: r for r in K.variogram_fit(spark.createDataFrame(rows, "mean_dist double, gamma double")).collect()}
    assert all(abs(r["psill"]) < 1e-9 and r["sse"] < 1e-12 for r in fit([(1.0, 0.0), (2.0, 0.0)]).values())
    down = fit([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)])
    assert set(down) == set(K.MODELS) and all(r["nugget"] <= 3.0 and r["psill"] >= 0 for r in down.values()) and abs(down["linear"]["nugget"] - 2.0) < 1e-9
    assert fit([]) == {}
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "id int, x double, y double, z double")
    assert K.variogram_bins(one).count() == 0 and K.fitted(one) is None
    place = K.variogram_bins(spark.createDataFrame([(i, 0.0, 0.0, float(i)) for i in range(3)], "id int, x double, y double, z double"))
    assert [r["pairs"] for r in place.collect()] == [3]


def test_power_kriging_uses_its_exponent(spark):
    p = points(40, 4)
    v = {"model": "power", "nugget": 0.0, "psill": 1.0, "range": 50.0, "exponent": 0.8}
    t = spark.createDataFrame(pd.DataFrame({"x": [10.0], "y": [20.0]}))
    got = K.krige_local(t, spark.createDataFrame(p), v, len(p), item_id="id").first()["krig"]
    g = lambda h: np.where(h == 0, 0.0, (h / 50.0) ** 0.8)
    a = np.ones((41, 41))
    a[:40, :40] = g(np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values))
    a[40, 40] = 0
    assert abs(got - float(np.linalg.solve(a, np.append(g(np.hypot(p.x - 10, p.y - 20)), 1.0))[:40] @ p.z.values)) < 1e-6


def test_splits_are_disjoint_by_group(spark, sf):
    b = samples(spark, sf).withColumn("block", block_of())
    s = W.split_rows(b, "block", [1, 2, 3])
    both = s.groupBy("seed", "block").agg(F.countDistinct("role").alias("r")).filter("r > 1").count()
    assert both == 0
    g = W.group_split(b, "block", [1, 2, 3]).groupBy("seed").agg(F.count_if(F.col("role") == "test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] == int(np.ceil(0.3 * r["n"])) for r in g)
    f = W.random_kfold(b.select("sample_id"), "sample_id").groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [1, 2, 3, 4, 5] and max(r["count"] for r in f) - min(r["count"] for r in f) <= 1


def test_intervals_nest_in_alpha_and_own_residual_counts(spark, sf):
    o = oof(spark, sf)
    q = lambda a, **k: {r["sample_id"]: r["qhat"] for r in U.local_qhat(o, o, alpha=a, **k).collect()}
    wide_q, narrow_q = q(0.05), q(0.3)
    assert all(wide_q[k] >= narrow_q[k] for k in wide_q)
    assert q(0.1, exclude_self="sample_id") != q(0.1)


def test_the_search_over_intervals_broadcasts_groups_not_rows(spark):
    """Rows that repeat are small files: the planner took them for the side to broadcast. The figures are those of each set on its own."""
    r = np.random.default_rng(3)
    p = pd.DataFrame({"sample_id": np.arange(600), "x": r.uniform(0, 2e5, 600), "y": r.uniform(0, 1e5, 600), "y_true": r.normal(50, 3, 600)})
    p["pred"] = 50.0
    p["abs_residual"] = (p.y_true - p.pred).abs()
    o = spark.createDataFrame(p)
    m = U.gcp_param_search(o)
    lines = m._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [[line for line in lines[i:] if "Aggregate" in line or "Scan" in line][0] for i, line in enumerate(lines) if "BroadcastExchange" in line]
    assert below and not [line for line in below if "FileScan" in line]
    got = {row["name"]: row for row in m.collect()}
    assert len(got) == len(U.PARAM_SETS)
    for name, a, k, scale, bw in U.PARAM_SETS[::2]:
        one = U.interval_metrics(U.prediction_intervals(U.local_qhat(o, o, alpha=a, neighbors=k, scale=scale, min_bw=bw)), a).first()
        assert all(abs(got[name][c] - one[c]) < 1e-9 for c in ("n", "picp", "mpiw", "nmpiw", "ccb", "interval_score", "median_width"))


def test_forest_predicts_better_than_the_mean(spark, sf):
    t = wide(spark, sf).withColumn("block", block_of()).cache()
    m = M.fit_rfk(t, "som", ["c_size", "c_cyc", "f_qty"], {"trees": 20, "depth": 5, "leaf": 1, "share": "auto"}, {"nlags": 6, "nearest": 8})
    p = m.predict(t).agg(F.avg(F.pow(F.col("pred") - F.col("som"), 2)).alias("e"), F.var_pop("som").alias("v")).first()
    assert p["e"] < 0.5 * p["v"]
    assert abs(sum(r["importance"] for r in m.importance().collect()) - 1.0) < 1e-9


def test_edge_fill_on_a_spiral(spark):
    n = 21
    wall = np.zeros((n, n), dtype=bool)
    for i in range(2, n - 2, 4):
        wall[i, : n - 2] = True
        wall[i + 2, 2:] = True
    bg = ~wall
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(bg))], "row int, col int")
    seen = np.zeros_like(bg)
    todo = [(r, c) for r in range(n) for c in range(n) if bg[r, c] and (r in (0, n - 1) or c in (0, n - 1))]
    while todo:
        r, c = todo.pop()
        if 0 <= r < n and 0 <= c < n and bg[r, c] and not seen[r, c]:
            seen[r, c] = True
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    got = {(x["row"], x["col"]) for x in edge_connected(cells, n, n).collect()}
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(seen))))


def test_coinciding_samples_do_not_depend_on_ids(spark):
    p = points(40, 7)
    many = pd.concat([p, p.assign(z=p.z + 0.2), p.assign(z=p.z - 0.1)], ignore_index=True)
    t = spark.createDataFrame(pd.DataFrame({"x": [10.0, 55.5, 80.0], "y": [20.0, 71.0, 5.0]}))
    got = []
    for ids in (np.arange(len(many)), np.random.default_rng(1).permutation(len(many))):
        rows = K.krige_local(t, spark.createDataFrame(many.assign(id=ids)), V, 16, item_id="id").collect()
        assert not any(r["fallback"] for r in rows)
        got.append(sorted((r["x"], round(r["krig"], 9)) for r in rows))
    one = K.krige_local(t, spark.createDataFrame(p.assign(z=p.z + 0.1 / 3)), V, 16, item_id="id").collect()
    assert got[0] == got[1] and np.allclose([z for _, z in got[0]], [r["krig"] for r in sorted(one, key=lambda r: r["x"])])


def test_splits_keep_rows_without_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(100)], "sample_id int, block int")
    assert W.split_rows(df, "block", [1, 2]).groupBy("seed").count().select("count").distinct().first()[0] == 100
    assert M.holdouts(df, "block", [1, 2]).count() == 100


def test_held_out_predictions_come_from_refits(spark, sf):
    t = wide(spark, sf).withColumn("block", block_of())
    rf = {"trees": 15, "depth": 6, "leaf": 2, "split": 4, "share": "0.8"}
    cv = M.cross_validate(t, "som", ["c_size", "c_cyc", "f_qty"], "block", [1, 2, 3], rf).toPandas()
    roles = W.split_rows(t.select("sample_id", "block"), "block", [1, 2, 3]).filter("role = 'test'").toPandas()
    assert sorted(zip(cv.fold, cv.sample_id)) == sorted(zip(roles.seed, roles.sample_id))
    one = M.run_split(W.split_rows(t, "block", [2]), "som", ["c_size", "c_cyc", "f_qty"], rf, None).toPandas()
    assert len(one) == (cv.fold == 2).sum() and ((one.pred - one.y_true) ** 2).mean() < one.y_true.var()
    oof_ = M.oof_table(spark.createDataFrame(cv)).toPandas()
    assert oof_.folds.sum() == len(cv) and (oof_.abs_residual >= 0).all()
    k = M.predict_folds(M.folds(W.random_kfold(t, "sample_id"), F.col("fold") - 1).drop("fold"), "som", ["c_size"], list(range(5)), rf)
    assert k.count() == k.select("sample_id").distinct().count() == t.filter("som is not null").count()


def test_tuning_locks_and_stops(spark, sf):
    t = wide(spark, sf).withColumn("block", block_of())
    n = t.agg(F.count("*").alias("n"))
    free, locked = M.candidates(n, "n"), M.candidates(n, "n", locks={"trees": 5, "depth": 3, "leaf": 1, "split": 2, "share": "1.0"})
    assert len(free) == 16 and free[0]["rf"]["trees"] == 1200 and {c["rf"]["trees"] for c in locked} == {5}
    same = M.candidates(n, "n", locks={"trees": 5, "depth": 3, "leaf": 1, "split": 2, "share": "1.0", "variogram": "linear", "nlags": 6, "nearest": 16, "weighted": False})
    assert len(same) == 1
    assert {c["krig"]["weighted"] for c in free} == {False, True}
    got = M.tune(t, "som", ["c_size", "c_cyc"], "block", [{**c, "rf": {**c["rf"], "trees": 5}} for c in free], list(range(1, 8)), finalists=1).collect()
    assert len(got) == 16 and sum(r["best"] for r in got) == 1 and sum(r["kriged"] for r in got) == 1
    few = M.tune(t, "som", ["c_size", "c_cyc"], "block", [{"rf": {**c["rf"], "trees": 5}} for c in free], [1, 2], goal_r2=-9.0, wave=4).collect()
    assert len(few) == 4


def test_the_search_judges_every_candidate_whole(spark, sf, monkeypatch):
    """All trees and the kriging of all candidates; candidates with one forest grow it once."""
    from loamgrid.plans import modelling as P

    seen, tune, fit = [], M.tune, M.fit_forests

    def small(df, target, features, group, cands, seeds, **kw):
        seen.append((cands, seeds, kw))
        return tune(df, target, features, group, [{**c, "rf": {**c["rf"], "trees": 5}} for c in cands[:3]], seeds[:1], **kw)

    monkeypatch.setattr(P.M, "tune", small)
    monkeypatch.setattr(M, "fit_forests", lambda rows, n, specs: seen.append(specs) or fit(rows, n, specs))
    got = P.q_tune(spark, sf).collect()
    (cands, seeds, kw), specs = seen
    assert len(cands) == 16 and {c["rf"]["trees"] for c in cands} == {500, 800, 1200} and len(seeds) == 7
    assert kw.get("finalists") is None and len(got) == 3 and all(r["kriged"] for r in got)
    assert cands[0]["rf"] == cands[1]["rf"] and len(specs) == 2


def test_pair_statistics_of_many_tiles(spark, monkeypatch):
    """Blocks, tiles and nodes against all pairs, with places that repeat and values that are missing."""
    g = np.random.default_rng(8)
    p = np.column_stack([g.uniform(0, 2e5, 3000), g.uniform(0, 1e5, 3000), g.normal(50, 3, 3000)])
    p[:300, :2] = p[0, :2]
    i, j = np.triu_indices(len(p), 1)
    d, v = np.hypot(p[i, 0] - p[j, 0], p[i, 1] - p[j, 1]), 0.5 * (p[i, 2] - p[j, 2]) ** 2
    monkeypatch.setattr(K, "UNIT", 700)
    monkeypatch.setattr(K, "BLOCK_ROWS", 200)
    looked = [0]
    near = K._dist
    monkeypatch.setattr(K, "_dist", lambda a, b, x, y: (looked.__setitem__(0, looked[0] + len(x) * a.x.shape[1] * b.x.shape[1]), near(a, b, x, y))[1])
    t = K._Tiles(p, 50.0)
    lo, hi = K._pair_range(t, t, True)
    assert lo == 0.0 and abs(hi - d.max()) < 1e-9 and looked[0] < len(d) / 4
    df = spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(p)] + [(9000, None, 1.0, 1.0)], "id long, x double, y double, z double")
    for got, cls in ((K.variogram_bins(df, 6).collect(), np.minimum(d // (d.max() / 6), 5)), (K.lag_pairs(df, 2000.0, 20000.0).collect(), np.where(d < 20000, d // 2000, -1))):
        assert sorted(r["lag"] for r in got) == sorted(set(cls.astype(int)) - {-1})
        for r in got:
            at = cls == r["lag"]
            assert r["pairs"] == at.sum() and abs(r["mean_dist"] / d[at].mean() - 1) < 1e-11 and abs(r["gamma"] / v[at].mean() - 1) < 1e-11
    gone = K.variogram_bins(df.withColumn("z", F.when(F.col("id") != 7, F.col("z"))), 6).collect()
    assert sum(r["pairs"] for r in gone) == len(d)


def test_pairs_of_one_class_are_halved_no_further(monkeypatch):
    """Two far blocks in one class are one pair of tiles, however many points they have."""
    g = np.random.default_rng(3)
    blocks = [np.column_stack([g.uniform(0, 100, 4096) + x, g.uniform(0, 100, 4096), g.normal(size=4096)]) for x in (0.0, 5000.0)]
    d = np.hypot(blocks[0][:, 0, None] - blocks[1][:, 0], blocks[0][:, 1, None] - blocks[1][:, 1])
    v = 0.5 * (blocks[0][:, 2, None] - blocks[1][:, 2]) ** 2
    a, b = (K._Tiles(p, 0.0) for p in blocks)
    seen, count = [0], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *w: (seen.__setitem__(0, seen[0] + len(x)), count(x, *w))[1])
    got = K._pair_stats(a, b, np.array([0.0, 1000.0, 20000.0]) + [0, 0, 0.001], False)
    assert seen[0] < 100 and got[0].tolist() == [0, d.size]
    assert abs(got[1][1] / d.sum() - 1) < 1e-11 and abs(got[2][1] / v.sum() - 1) < 1e-11


def test_scores_in_gathered_batches(monkeypatch):
    """Trees are read once for many batches; rows keep their order."""
    from loamgrid.operators import forest

    monkeypatch.setattr(forest, "GATHER", 10)
    parts = list(forest._gathered(np.full((4, 1), i) for i in range(7)))
    assert [len(p) for p in parts] == [3, 3, 1] and [int(x[0, 0]) for p in parts for x in p] == list(range(7))


def test_large_map_is_not_broadcast(spark, monkeypatch, sf):
    """The planner knows the size of the map's table."""
    from loamgrid.plans import views

    monkeypatch.setattr(views, "layout", lambda *_: views.Layout(1728, 2208, 5000 / 48))
    g = views.grid(spark, sf)
    assert int(str(g._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 10 << 20
    plan = g.join(spark.range(1 << 30).select(F.col("id").alias("row"), F.col("id").alias("v")), "row")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
