import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loamgrid.operators import ordering as O
from loamgrid.operators.chat import dedupe_recent


def test_exact_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", 100)  # forces the bracketed path
    r = np.random.default_rng(1)
    v = np.concatenate([r.lognormal(size=4000), np.full(3000, 2.5), r.normal(size=2000)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 2, "v": v})).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    got = O.exact_quantiles(df, "v", probs).first()["q"]
    assert np.allclose(got, np.quantile(v, probs))
    for row in O.exact_quantiles(df, "v", probs, ["g"]).collect():
        assert np.allclose(row["q"], np.quantile(v[np.arange(len(v)) % 2 == row["g"]], probs))


def test_quantiles_of_few_groups_equal_numpy_without_a_shuffle_of_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", 100)
    monkeypatch.setattr(O, "COUNT_ROWS", 700)
    r = np.random.default_rng(6)
    v = np.concatenate([r.lognormal(size=4000), np.full(3000, 2.5), r.normal(size=2000)])
    p = pd.DataFrame({"g": np.array(["a", "b"])[np.arange(len(v)) % 2], "v": v})
    df = spark.createDataFrame(p).repartition(7)
    for probs in ([0.5], [i / 128 for i in range(1, 128)], [0.9, 0.1, 0.5, 0.0, 1.0, 0.2, 0.3, 0.4, 0.6]):
        q = O.exact_quantiles(df, "v", probs, ["g"], few=True)
        assert "SortMergeJoin" not in q._jdf.queryExecution().executedPlan().toString()
        for row in q.collect():
            assert np.allclose(row["q"], np.quantile(p.v[p.g == row["g"]], probs))


def test_running_equals_pandas_with_a_hot_group(spark):
    r = np.random.default_rng(2)
    n = 3000
    p = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, 1, r.integers(2, 30, n)), "o": r.permutation(n), "v": r.integers(-5, 9, n).astype(float)})
    df = spark.createDataFrame(p)
    want = p.sort_values("o")
    want = want.assign(s=want.groupby("g").v.cumsum(), m=want.groupby("g").v.cummax()).set_index("o")
    for how, col in (("sum", "s"), ("max", "m")):
        for row in O.running(df, ["g"], ["o"], F.col("v"), how, ranges=16).collect():
            assert row["running"] == want.loc[row["o"], col]


def test_global_rank(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.integers(0, 50, 500), np.full(300, 7)])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "i": np.arange(len(v))}))
    rows = O.global_rank(df, ["v", "i"], "r", "n", ranges=10).collect()
    order = sorted((x["v"], x["i"]) for x in rows)
    assert [order[x["r"] - 1] for x in rows] == [(x["v"], x["i"]) for x in rows]
    assert {x["n"] for x in rows} == {len(v)}


def test_dedupe_recent_equals_a_plain_walk(spark):
    r = np.random.default_rng(4)
    rows = []
    for conv in range(6):
        for turn in range(400 if conv == 0 else 60):
            role = "assistant" if r.random() < 0.7 else "user"
            rows.append((conv, turn, role, f"m  {r.integers(0, 40 if turn % 100 < 50 else 4000)}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = set()
    hist = {}
    for conv, turn, role, text in rows:
        h = hist.setdefault(conv, [])
        key = " ".join(text.split()) if role == "assistant" else None
        if key is not None and key in h[-10:]:
            continue
        h.append(key)
        want.add((conv, turn))
    got = dedupe_recent(df, "conv_id", "turn", span=64).collect()
    assert {(x["conv_id"], x["turn"]) for x in got} == want


def test_null_keys_keep_their_rows(spark):
    rows = [(None if i % 10 == 0 else i % 7, None if i % 4 == 0 else i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    ranked = O.global_rank(df, ["o", "v"], "r", "n", ranges=4).collect()
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
    assert sorted((x["r"], x["v"]) for x in ranked) == [(i + 1, x[2]) for i, x in enumerate(want)]
    got = {x["v"]: x["running"] for x in O.running(df, ["g"], ["o", "v"], F.col("v"), ranges=4).collect()}
    sums, expect = {}, {}
    for g, _, v in want:
        sums[g] = expect[v] = sums.get(g, 0) + v
    assert got == expect


def test_ranges_stay_even_on_skewed_and_tied_values(spark):
    r = np.random.default_rng(4)
    for v in (r.lognormal(0, 3, 8000), np.where(r.random(8000) < 0.9, 1.0, r.random(8000))):
        df = spark.createDataFrame(pd.DataFrame({"v": v, "i": np.arange(len(v))}))
        sizes = [x["count"] for x in O.in_ranges(df, ["v", "i"], 8).groupBy("__b").count().collect()]
        assert max(sizes) <= 2 * len(v) / 8
