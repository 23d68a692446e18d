"""Correlations of pairs of columns, and cells under points, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import aggregates as A
from loamgrid.operators import raster as R


@pytest.mark.parametrize("parts", [1, 7])
def test_pairwise_complete_correlations(spark, monkeypatch, parts):
    g = np.random.default_rng(2)
    d = pd.DataFrame(g.normal(size=(300, 6)), columns=list("abcdef"))
    d["b"] = 2 * d["a"] + 0.01 * d["b"] + 1e6
    d["e"] = 0.1
    d = d.mask(g.random(d.shape) < 0.2)
    d["f"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in d.values] + [(float("inf"),) + (None,) * 5, (None,) * 6]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(parts)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in A.pair_moments(df, list("abcdef")).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            both = d.iloc[:, [i, j]].dropna()
            if not len(both):
                assert (i, j) not in got
                continue
            n, r = got[i, j]
            assert n == len(both)
            if 4 in (i, j):
                assert r is None
            else:
                assert abs(r - np.corrcoef(both.values.T)[0, 1]) < 1e-9
    assert [(r["a"], r["b"]) for r in A.high_corr_pairs(df, list("abcdef")).collect()] == [("a", "b")]


def test_no_rows_or_one_column(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert A.high_corr_pairs(df.limit(0), ["a", "b"]).count() == 0
    assert A.high_corr_pairs(df, ["a"]).count() == 0 and A.high_corr_pairs(df, []).count() == 0


def test_three_hundred_columns_are_one_scan(spark):
    wide = spark.range(2000).select(*[(F.hash("id", F.lit(i)) % 1000).cast("double").alias(f"v{i}") for i in range(299)], (F.hash("id", F.lit(0)) % 1000 * 3.0).alias("v299"))
    assert [(r["a"], r["b"]) for r in A.high_corr_pairs(wide, wide.columns).collect()] == [("v0", "v299")]


def test_cells_under_points(spark):
    cells = spark.createDataFrame([("q", 0, 0, 1.0), ("q", 0, 1, 2.0), ("s", 0, 0, 3.0), ("q", 5, 5, 9.0)], "layer string, row int, col int, value double")
    pts = spark.createDataFrame([(1, 5.0, 95.0), (2, 15.0, 95.0), (3, 500.0, 95.0), (4, None, 95.0), (5, 6.0, 96.0)], "id int, x double, y double")
    got = {r["id"]: (r["q"], r["s"]) for r in R.sample_at_points(pts, cells, ["q", "s"], 0.0, 100.0, 10.0).collect()}
    assert got == {1: (1.0, 3.0), 2: (2.0, None), 3: (None, None), 4: (None, None), 5: (1.0, 3.0)}
