"""Forests against a plain recursive tree, and the distributed levels against the local ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import forest as T


def table(n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, (n, 3)).round(2)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.5) + r.normal(0, 0.1, n)
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": r.integers(1, 4, n).astype(float)})


def cols():
    return [F.col(c) for c in "abc"]


def plain(x, y, w, leaf, split, depth):
    """Value of a single tree by recursion, as a function of a row."""
    mean = (w * y).sum() / w.sum()
    best = (1e-12, None, None)
    if len(y) >= split and depth > 0:
        for f in range(x.shape[1]):
            for lo, hi in zip(np.unique(x[:, f])[:-1], np.unique(x[:, f])[1:]):
                left = x[:, f] <= lo
                if min(left.sum(), (~left).sum()) >= leaf:
                    parts = [w[m].sum() * ((w[m] * y[m]).sum() / w[m].sum() - mean) ** 2 for m in (left, ~left)]
                    if sum(parts) > best[0] * (1 + 1e-9):
                        best = (sum(parts), f, lo + (hi - lo) / 2)
    if best[1] is None:
        return lambda row: mean
    f, t = best[1:]
    left = x[:, f] <= t
    a, b = (plain(x[m], y[m], w[m], leaf, split, depth - 1) for m in (left, ~left))
    return lambda row: a(row) if row[f] <= t else b(row)


@pytest.mark.parametrize("leaf,split,depth", [(1, 2, 0), (3, 6, 4), (1, 2, 1), (2, 40, 5)])
def test_trees_equal_recursion(leaf, split, depth):
    p = table(120, 3)
    x, y, w = p[["a", "b", "c"]].to_numpy(), p.y.to_numpy(), p.w.to_numpy()
    spec = {"trees": 3, "leaf": leaf, "split": split, "depth": depth, "share": "1.0"}
    counts = [T.in_bag(p.id.to_numpy(), t, 42) for t in range(3)]
    rows = [np.flatnonzero(c) for c in counts]
    at, tree = np.concatenate(rows), np.repeat(np.arange(3), [len(r) for r in rows])
    got = T.grow(x[at], y[at], np.concatenate([(c * w)[r] for c, r in zip(counts, rows)]), tree, np.arange(3), spec)
    for t in range(3):
        want = plain(x[rows[t]], y[rows[t]], (counts[t] * w)[rows[t]], leaf, split, depth or 99)
        assert np.allclose(got.value[got.at(x, t)[:, 0]], [want(r) for r in x])


def test_bags_hold_a_poisson_count():
    c = T.in_bag(np.arange(100_000), 7, 42)
    assert abs(c.mean() - 1) < 0.02 and abs((c == 0).mean() - np.exp(-1)) < 0.01
    assert T.n_features("sqrt", 10) == 3 and T.n_features("0.5", 7) == 3 and T.n_features("1.0", 7) == 7


def test_forests_of_folds_in_one_job(spark):
    p = table()
    p["test"] = (p.id % 2) + 2 * (p.id % 3 == 0)
    df = spark.createDataFrame(p).repartition(5)
    rows = T.pack(df, F.col("id"), F.col("y"), cols(), F.col("w"), F.col("test"))
    specs = [{"trees": 40, "fold": 0, "share": "1.0"}, {"trees": 40, "fold": 1, "share": "sqrt", "leaf": 2}, {"trees": 5, "fold": 1, "depth": 1, "share": "1.0"}]
    got = T.fit_forests(rows, 3, specs)
    out = got.scores(df, F.col("id"), cols(), F.col("test")).where("held").toPandas()
    assert (out.groupby("spec").key.nunique() == [(p.id % 2 == 1).sum(), (p.id % 3 == 0).sum(), (p.id % 3 == 0).sum()]).all()
    for s, limit in ((0, 0.1), (1, 0.3)):
        m = out[out.spec == s].merge(p, left_on="key", right_on="id")
        assert ((m.trend - m.y) ** 2).mean() < limit * p.y.var()
    imp = got.importances().toPandas()
    assert np.allclose(imp.groupby("spec").importance.sum(), 1) and imp[(imp.spec == 0) & (imp.feature == 2)].importance.iloc[0] < 0.1
    # The same rows in other partitions give the same forest.
    again = T.fit_forests(T.pack(df.repartition(2), F.col("id"), F.col("y"), cols(), F.col("w"), F.col("test")), 3, specs).scores(df, F.col("id"), cols(), F.col("test")).where("held").toPandas()
    key = ["spec", "key"]
    assert np.allclose(out.sort_values(key).trend, again.sort_values(key).trend)


def test_large_nodes_are_grown_on_all_blocks(spark):
    p = table(1500, 5)
    df = spark.createDataFrame(p).repartition(4)
    rows = T.pack(df, F.col("id"), F.col("y"), cols())
    spec = {"trees": 8, "depth": 9, "leaf": 2, "split": 5, "share": "1.0"}
    small, whole = T.fit_forests(rows, 3, [spec], local=100), T.fit_forests(rows, 3, [spec])
    a, b = (m.predict(df, cols()).select("id", "y", "trend").toPandas().sort_values("id") for m in (small, whole))
    assert ((a.trend - a.y) ** 2).mean() < 0.1 * p.y.var() and np.corrcoef(a.trend, b.trend)[0, 1] > 0.99
    assert abs(small.importances().toPandas().importance.sum() - 1) < 1e-9
    # A stump's split and values, brute force over the histogram's edges.
    stump = T.fit_forests(rows, 3, [{"trees": 1, "depth": 1, "share": "1.0"}], local=100).predict(df, cols()).select("id", "trend").toPandas().sort_values("id")
    c = T.in_bag(p.id.to_numpy(), 0, 42)
    best = max(((c * (p[f] <= e)).sum() * ((c * p.y)[p[f] <= e].sum() / (c * (p[f] <= e)).sum() - (c * p.y).sum() / c.sum()) ** 2 + (c * (p[f] > e)).sum() * ((c * p.y)[p[f] > e].sum() / (c * (p[f] > e)).sum() - (c * p.y).sum() / c.sum()) ** 2, f, e) for f in "abc" for e in np.unique(np.quantile(p[f], np.arange(1, 128) / 128)))
    left = (p[best[1]] <= best[2]).to_numpy()
    assert np.allclose(stump.trend[left], (c * p.y)[left].sum() / c[left].sum()) and np.allclose(stump.trend[~left], (c * p.y)[~left].sum() / c[~left].sum())


def test_nodes_read_only_the_blocks_they_can_meet(spark, monkeypatch):
    p = table(1500, 5)
    df = spark.createDataFrame(p).repartition(4)
    rows, spec = T.pack(df, F.col("id"), F.col("y"), cols()), {"trees": 6, "depth": 9, "leaf": 2, "split": 5, "share": "1.0"}
    trend = lambda: T.fit_forests(rows, 3, [spec], local=100).predict(df, cols()).select("id", "trend").toPandas().sort_values("id").trend
    want, seen, plan = trend(), [], T._hauls
    monkeypatch.setattr(T, "HAUL", 150), monkeypatch.setattr(T, "SHELF", 32), monkeypatch.setattr(T, "SLAB", 400)
    monkeypatch.setattr(T, "_hauls", lambda tops, shelf, features: seen.append((plan(tops, shelf, features), shelf)) or seen[0][0])
    assert np.allclose(trend(), want)
    hauls, shelf = seen[0]
    assert sum(n for _, n, _, _ in shelf) == 1500 and len(shelf) > 10
    # Rows are read about once for each tree, not once for each piece of work, and nothing of them is sent along.
    assert len(hauls) > 6 * 5 and sum(len(files) for *_, files in hauls) < 0.5 * len(hauls) * len(shelf)


def test_many_levels_of_equal_rows_and_stored_trees():
    p = table(300, 8)
    x, y = p[["a", "b", "c"]].to_numpy(), p.y.to_numpy()
    got = T.grow(x, y, np.ones(300), np.arange(300) % 2, np.arange(2), {"share": "sqrt", "depth": 6})
    data = got.dump()
    back = T.Trees.load(data)
    assert np.array_equal(got.value[got.at(x)], back.value[back.at(x)]) and len(data) < 16 * len(got.feature) + 2000


def test_forests_of_nothing(spark):
    df = spark.createDataFrame(table(10)).withColumn("y", F.lit(None).cast("double"))
    got = T.fit_forests(T.pack(df, F.col("id"), F.col("y"), cols()), 3, [{"trees": 4}])
    assert [r["trend"] for r in got.predict(df, cols()).collect()] == [None] * 10


def test_trees_for_all_cores_are_grown_without_a_shuffle(spark, monkeypatch):
    p = table(1500, 5)
    df = spark.createDataFrame(p).repartition(4)
    rows, spec = T.pack(df, F.col("id"), F.col("y"), cols()), {"trees": 40, "depth": 9, "leaf": 2, "split": 5, "share": "1.0"}
    plans, rest = [], T._grow_rest

    def seen(*args):
        made = rest(*args)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(T, "_grow_rest", seen), monkeypatch.setattr(T, "SLAB", 400), monkeypatch.setattr(T, "SHELF", 200)
    trend = lambda: T.fit_forests(rows, 3, [spec], local=100).predict(df, cols()).select("id", "trend").toPandas().sort_values("id").trend
    want = trend()  # few chunks: histograms and nodes are sent
    monkeypatch.setattr(T, "CHUNK", 1)
    assert np.allclose(trend(), want)
    assert "Exchange" in plans[0] and "Exchange" not in plans[1]


def test_test_rows_only_are_scored(spark):
    p = table(300, 2)
    p["test"] = (p.id % 2) + 2 * (p.id % 3 == 0)
    df = spark.createDataFrame(p)
    got = T.fit_forests(T.pack(df, F.col("id"), F.col("y"), cols(), test=F.col("test")), 3, [{"trees": 3, "fold": 0}, {"trees": 3, "fold": 1}])
    every, held = (got.scores(df, F.col("id"), cols(), F.col("test"), h).toPandas().sort_values(["spec", "key"]).reset_index(drop=True) for h in (False, True))
    assert len(every) == 600 and held.held.all() and held.equals(every[every.held].reset_index(drop=True))


def test_rows_numbered_anew_give_the_same_trees(monkeypatch):
    p = table(3000, 9)
    x, y = p[["a", "b", "c"]].to_numpy(), p.y.to_numpy()
    x[:, 1] = np.arange(3000)
    for share in ("1.0", "sqrt"):
        trees = []
        for levels in ((), range(60), T.RENEW):
            monkeypatch.setattr(T, "RENEW", frozenset(levels))
            trees.append(T.grow(x, y, p.w.to_numpy(), np.arange(3000) % 3, np.arange(3), {"share": share, "leaf": 2}))
        for t in trees[1:]:
            assert all(np.array_equal(getattr(t, c), getattr(trees[0], c), equal_nan=True) for c in ("feature", "threshold", "child", "value", "gain"))
    assert len(trees[0].dump()) < 10 * len(trees[0].feature) + 2000


def test_rows_by_tree_and_value_are_stable():
    r = np.random.default_rng(3)
    for v in (r.normal(size=100_000), r.integers(0, 90_000, 100_000).astype(float), r.integers(0, 4, 100_000).astype(float)):
        for m in (1, 3, 70_000):
            tree = r.integers(0, m, len(v))
            assert np.array_equal(T._sorted(v, tree, m), np.lexsort((v, tree)))


def test_whole_tops_are_those_of_all_blocks(spark, monkeypatch):
    """A task that holds all binned rows grows the tops that histograms level by level give, bit by bit."""
    p = table(1500, 5)
    p["y"], p["w"], p["test"] = (64 * p.y).round() / 64, p.id % 4 + 1.0, p.id % 4  # sums without rounding, in whatever order
    df = spark.createDataFrame(p).repartition(4)
    rows = T.pack(df, F.col("id"), F.col("y"), cols(), F.col("w"), F.col("test"))
    specs = [{"trees": 20, "depth": 4, "leaf": 3, "split": 8, "share": "sqrt", "fold": 0}, {"trees": 20, "share": "1.0", "fold": 1}]
    seen, all_blocks, whole = [], T._grow_tops, []
    monkeypatch.setattr(T, "CHUNK", 1), monkeypatch.setattr(T, "SLAB", 400), monkeypatch.setattr(T, "SHELF", 200)
    monkeypatch.setattr(T, "_grow_tops", lambda *a: seen.append(all_blocks(*a)) or seen[-1])
    alone = T._grow_whole_tops
    monkeypatch.setattr(T, "_grow_whole_tops", lambda *a: whole.append(1) or alone(*a))
    for held in (T.HELD, 0):
        monkeypatch.setattr(T, "HELD", held)
        T.fit_forests(rows, 3, specs, local=100)
    assert whole == [1] and len(seen[0]) == 40 and max(len(t[0].feature) for t in seen[0]) > 10
    for (a,), (b,) in zip(*seen):
        assert all(getattr(a, c) == getattr(b, c) for c in ("feature", "threshold", "child", "gain", "depth", "size", "open"))
