"""The neighbour join against brute force, on both layouts and on skewed places."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import neighbors as N


def cloud(n, seed, hot=0.0):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 1000, n), r.uniform(0, 500, n)
    h = int(n * hot)
    x[:h], y[:h] = 123.0, 77.0
    return pd.DataFrame({"sample_id": np.arange(n), "x": x, "y": y, "v": r.normal(size=n)})


def brute(t, p, k):
    d = np.sqrt((t.x.values[:, None] - p.x.values) ** 2 + (t.y.values[:, None] - p.y.values) ** 2)
    out = []
    for row in d:
        o = np.lexsort((p.sample_id.values, row))[:k]
        out.append([(round(row[i], 9), int(p.sample_id.values[i])) for i in o])
    return out


@pytest.mark.parametrize("hot", [0.0, 0.34])
@pytest.mark.parametrize("limit", [N.BROADCAST_ROWS, 0])
def test_matches_brute_force(spark, monkeypatch, hot, limit):
    monkeypatch.setattr(N, "UNIT_ROWS", 97)
    t, p = cloud(300, 1, hot), cloud(1500, 2, hot)
    j = N.knn_join(spark.createDataFrame(t), spark.createDataFrame(p), 7, carry=["v"], broadcast_rows=limit)
    got = {r["sample_id"]: r["neighbors"] for r in j.select("sample_id", "neighbors").collect()}
    assert len(got) == 300
    for i, want in enumerate(brute(t, p, 7)):
        assert [(round(n["dist"], 9), n["id"]) for n in got[i]] == want
        assert all(abs(n["v"] - p.v[n["id"]]) < 1e-12 for n in got[i])


@pytest.mark.parametrize("limit", [N.BROADCAST_ROWS, 0])
def test_vectors_and_missing_targets(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "UNIT_ROWS", 50)
    r = np.random.default_rng(3)
    a = r.normal(size=(200, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "sample_id long, v array<double>")
    df = df.withColumn("v", F.when(F.col("sample_id") == 9, None).otherwise(F.col("v")))
    j = N.knn_join(df, df, 2, target_coords=F.col("v"), item_coords=F.col("v"), broadcast_rows=limit)
    got = {x["sample_id"]: x["neighbors"] for x in j.collect()}
    assert got[9] == []
    keep = [i for i in range(200) if i != 9]
    for i in keep:
        d = np.sqrt(((a[i] - a[keep]) ** 2).sum(axis=1))
        assert got[i][0]["id"] == i and abs(got[i][1]["dist"] - np.sort(d)[1]) < 1e-9


@pytest.mark.parametrize("limit", [N.BROADCAST_ROWS, 0])
def test_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "UNIT_ROWS", 40)
    r = np.random.default_rng(4)
    t = cloud(200, 5)
    s = pd.DataFrame(r.uniform(0, 1000, (150, 4)), columns=["x1", "y1", "x2", "y2"])
    s["seg_id"] = np.arange(150)
    s.loc[3, ["x2", "y2"]] = s.loc[3, ["x1", "y1"]].values
    j = N.nearest_line_distance(spark.createDataFrame(t), spark.createDataFrame(s), broadcast_rows=limit)
    got = {x["sample_id"]: x["dist"] for x in j.collect()}
    for i in range(200):
        best = np.inf
        for a in s.itertuples():
            dx, dy = a.x2 - a.x1, a.y2 - a.y1
            ll = dx * dx + dy * dy
            u = 0.0 if ll == 0 else min(1.0, max(0.0, ((t.x[i] - a.x1) * dx + (t.y[i] - a.y1) * dy) / ll))
            best = min(best, np.hypot(t.x[i] - a.x1 - u * dx, t.y[i] - a.y1 - u * dy))
        assert abs(got[i] - best) < 1e-9


@pytest.mark.parametrize("rows", [16, 1 << 16])
def test_items_are_gathered_for_chunks_of_targets(spark, monkeypatch, rows):
    """No neighbour lists are merged where the items of a chunk are little data; rows without a place stay, equal rows too."""
    monkeypatch.setattr(N, "UNIT_ROWS", 60)
    monkeypatch.setattr(N, "CHUNK_ROWS", rows)
    t, p = cloud(2_000, 1, 0.05), cloud(1_500, 2, 0.1)
    df = spark.createDataFrame(pd.concat([t, t[:9]], ignore_index=True)).withColumn("x", F.when(F.col("sample_id") != 500, F.col("x")))
    with monkeypatch.context() as m:
        m.setattr(N, "_paired", lambda *a: pytest.fail("lists are merged"))
        j = N.knn_join(df, spark.createDataFrame(p), 60, carry=["v"], broadcast_rows=0)
    got = [(r["sample_id"], [(round(n["dist"], 9), n["id"]) for n in r["neighbors"]]) for r in j.collect()]
    want = dict(enumerate(brute(t, p, 60))) | {500: []}
    assert len(got) == 2_009 and {i for i, _ in got} == set(range(2_000))
    assert all(n == want[i] for i, n in got)
    far = N.nearest_distance(df.withColumn("x", F.col("x") + 1e6), spark.createDataFrame(p), self_id="sample_id", broadcast_rows=0)
    assert far.filter("dist > 9e5").count() == 2_008 and far.filter("dist is null").count() == 1


def test_chunks_keep_columns_that_are_never_null(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT_ROWS", 60)
    t, p = spark.createDataFrame(cloud(500, 1)), spark.createDataFrame(cloud(600, 2))
    j = N.nearest_distance(t.withColumn("zw", F.array(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)))), p, target_coords=F.col("zw"), broadcast_rows=0)
    assert j.filter("zw[0] = x and dist >= 0").count() == 500


def test_fewer_items_than_k(spark):
    t, p = cloud(5, 1), cloud(3, 2)
    j = N.knn_join(spark.createDataFrame(t), spark.createDataFrame(p), 10)
    assert all(len(r["neighbors"]) == 3 for r in j.collect())
    e = N.knn_join(spark.createDataFrame(t), spark.createDataFrame(p).limit(0), 4)
    assert all(r["neighbors"] == [] for r in e.collect())


def test_few_tiles_are_searched_in_feature_space():
    r = np.random.default_rng(8)
    centres = r.normal(0, 10, (40, 5))
    items = centres[r.integers(0, 40, 20_000)] + r.normal(0, 0.5, (20_000, 5))
    targets = centres[r.integers(0, 40, 8_000)] + r.normal(0, 0.5, (8_000, 5))
    index = N._Index(items, np.arange(len(items)), np.zeros((len(items), 0)), "point")
    blocks = 0
    for rows, d, _ in index.search(targets, 3):
        blocks += 1
        want = np.sort(np.sqrt(((targets[rows][:, None] - items[None]) ** 2).sum(2)), axis=1)[:, :3]
        assert np.allclose(d, want)
    assert index.searched / (blocks * len(index.n)) < 0.1


def clusters(spark, n, seed, first=0):
    r = np.random.default_rng(5)
    centres = r.normal(0, 10, (40, 5))
    r = np.random.default_rng(seed)
    a = centres[r.integers(0, 40, n)] + r.normal(0, 0.5, (n, 5))
    df = pd.DataFrame({"sample_id": np.arange(first, first + n), "v": a.tolist()})
    return a, spark.createDataFrame(df, "sample_id long, v array<double>")


def test_few_unit_pairs_in_feature_space(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT_ROWS", 100)
    a, items = clusters(spark, 12_000, 1)
    b, targets = clusters(spark, 4_000, 2)
    it = items.select(F.col("v").alias("__v"), F.col("sample_id").alias("__id"))
    parts, first = N._first_pass(targets.withColumn("__t", F.col("v")), it, 3, 12_000, 5, [], "point")
    assert parts.groupBy("__unit").count().agg(F.max("count")).first()[0] <= 150
    units, chunks = parts.select("__unit").distinct().count(), first.select("__chunk").distinct().count()
    links = first.select("__chunk", F.explode("__units")).distinct().count() + chunks
    assert links < 0.1 * units * chunks
    per_target = first.agg(F.avg(F.size("__units")) + 1).first()[0]
    assert per_target < 0.05 * units

    j = N.nearest_distance(targets, items, target_coords=F.col("v"), item_coords=F.col("v"), broadcast_rows=0)
    got = {r["sample_id"]: r["dist"] for r in j.select("sample_id", "dist").collect()}
    for i in range(0, 4_000, 7):
        assert abs(got[i] - np.sqrt(((a - b[i]) ** 2).sum(1)).min()) < 1e-9


def test_units_stay_bounded_above_the_number_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT_ROWS", 50)
    monkeypatch.setattr(N, "MAX_TILES", 4)
    t, p = cloud(200, 1), cloud(2_000, 2)
    p.loc[:99, ["x", "y"]] = [500.0, 250.0]
    j = N.knn_join(spark.createDataFrame(t), spark.createDataFrame(p), 5, broadcast_rows=0)
    got = {r["sample_id"]: r["neighbors"] for r in j.select("sample_id", "neighbors").collect()}
    for i, want in enumerate(brute(t, p, 5)):
        assert [(round(n["dist"], 9), n["id"]) for n in got[i]] == want


def test_a_tree_of_equal_points_has_one_full_leaf():
    same = np.ones((64, 3))
    leaves = N._Splits(same, 8).leaf(same)
    assert len(set(leaves.tolist())) == 1
    x = np.random.default_rng(1).normal(size=(512, 3))
    assert np.bincount(N._Splits(x, 8).leaf(x), minlength=8).tolist() == [64] * 8


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_many_axes_by_matrix_products(monkeypatch, far):
    """The same items and the same distances as measured one by one, also with ties and far from the origin."""
    r = np.random.default_rng(6)
    c = r.normal(size=(900, 64)) + far
    c[500:520] = c[3]
    t = np.concatenate([c[:90], r.normal(size=(40, 64)) + far])
    d = N._distances(t, c, "point")
    want = N._top_k(d, 5)
    seen = []
    slow = N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b, kind: (seen.append(a.shape), slow(a, b, kind))[1])
    pick, dist = N._nearest(t, c, 5, "point")
    assert (pick == want).all() and (dist == np.take_along_axis(d, want, axis=1)).all()
    assert not seen if far == 0 else True


def test_long_segments_do_not_widen_the_tiles_of_short_ones():
    r = np.random.default_rng(12)
    a = r.uniform(0, 200_000, (20_000, 2))
    far, long, axis = r.uniform(-2000, 2000, (20_000, 2)), np.flatnonzero(r.random(20_000) < 0.1), r.integers(0, 2, 20_000)
    far[long, axis[long]] = r.uniform(-200_000, 200_000, len(long))
    c, t = np.column_stack([a, a + far]), r.uniform(0, 200_000, (4000, 2))
    ix = N._Index(c, np.arange(len(c)), np.empty((len(c), 0)), "segment")
    for n, (rows, d, items) in enumerate(ix.search(t, 3)):
        if n < 3:
            assert np.array_equal(np.sort(N._distances(t[rows], c, "segment"), axis=1)[:, :3], d)
    assert ix.searched / (n + 1) < 0.35 * len(ix.starts)


def test_targets_of_one_file_are_dealt_to_many_tasks(spark, sf):
    import __spark_entry__ as e

    for name in ("nearest_line_distance", "request_spec"):
        assert e.queries()[name](spark, sf).select(F.spark_partition_id()).distinct().count() > 4


@pytest.mark.parametrize("axes", [3, 12])
def test_units_are_read_where_they_are_needed(spark, monkeypatch, axes):
    """Neither items nor targets are sent for a pair of units; ties, equal places, missing values and short lists are those of brute force."""
    monkeypatch.setattr(N, "UNIT_ROWS", 60)
    r = np.random.default_rng(11)
    a = r.normal(size=(700, axes)).round(1)
    a[:80] = a[100]
    rows = [(i, [float(v) for v in x], float(i % 7)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "sample_id long, v array<double>, c double")
    targets = df.withColumn("v", F.when(F.col("sample_id") != 300, F.col("v")))
    it = df.select(F.col("v").alias("__v"), F.col("sample_id").alias("__id"), "c")
    none = F.array_repeat(F.lit(float("nan")), axes)
    got = N._paired(targets.withColumn("__t", F.coalesce("v", none)), it, 9, 700, axes, ["c"], "point")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "explode" not in plan
    found = {x["sample_id"]: x["__nn"] for x in got.collect()}
    assert len(found) == 700 and found[300] == []
    d = N._distances(a, a, "point")
    for i in set(range(700)) - {300}:
        want = np.lexsort((np.arange(700), d[i]))[:9]
        assert [(n["dist"], n["id"], n["c"]) for n in found[i]] == [(d[i, j], j, float(j % 7)) for j in want]
    few = N._paired(targets.withColumn("__t", F.coalesce("v", none)), it.filter("__id < 105 and __id >= 100"), 5, 5, axes, ["c"], "point")
    assert {len(x["__nn"]) for x in few.collect()} == {0, 5}


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1.0, 1e6), (1e20, 0.0), (1e-20, 0.0)])
def test_pairs_within_a_bound_in_many_axes(scale, shift):
    r = np.random.default_rng(4)
    c, t = (r.normal(size=(n, 20)) * scale + shift for n in (900, 300))
    c[5:9] = c[4]
    d = N._distances(t, c, "point")
    bound = np.sort(d, axis=1)[:, 3]
    row, item, got = N._Wide(c).within(t, bound)
    want = np.nonzero(d <= bound[:, None])
    assert np.array_equal(row, want[0]) and np.array_equal(item, want[1]) and np.array_equal(got, d[want])
