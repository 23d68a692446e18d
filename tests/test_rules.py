"""Decision rules with nulls, ties and empty tables; ranks by refinement; band maps from tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import rules as R
from loamgrid.operators import uncertainty as U
from loamgrid.sources import documents as D


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_column_rules(spark):
    null = F.lit(None).cast("double")
    s, c = one(spark, *R.aspect_sincos(F.lit(90.0)))
    assert abs(s - 1) < 1e-12 and abs(c) < 1e-12
    assert one(spark, R.silt(F.lit(40.0), F.lit(25.0)), R.silt(F.lit(40.0), null)) == (35.0, None)
    assert one(spark, *R.middle_and_range(F.lit(30.0), F.lit(10.0)), R.water_balance(F.lit(5.0), F.lit(7.0))) == (20.0, 20.0, -2.0)
    got = one(spark, *[R.resolution_acceptable(a, b) for a, b in ((F.lit(250.0), F.lit(250.0)), (F.lit(500.0), F.lit(250.0)), (null, F.lit(250.0)), (null, null))])
    assert got == (True, False, False, True)
    assert one(spark, *[R.binary_class_mask(v, 1) for v in (F.lit(1.2), F.lit(2.0), null, F.lit(float("nan")))]) == (1, 0, 255, 255)
    assert one(spark, *[R.write_back_nodata(v, ok) for v, ok in ((F.lit(3.0), F.lit(True)), (F.lit(3.0), F.lit(False)), (null, F.lit(True)), (F.lit(3.0), F.lit(None).cast("boolean")))]) == (3.0, -9999.0, -9999.0, -9999.0)
    assert one(spark, R.product_score(F.lit(3), (F.lit(True), 50), (F.lit(None).cast("boolean"), 100)), R.product_score(F.lit(None).cast("int"))) == (147, 1)


def test_map_width_and_scale_bar(spark):
    width = one(spark, R.map_width_km(F.lit(100.0), F.lit(29.0), F.lit(102.0), F.lit(31.0)), R.map_width_km(F.lit(0.0), F.lit(89.0), F.lit(1.0), F.lit(90.0)), R.map_width_km(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert np.allclose(width, [2 * 111.32 * math.cos(math.radians(30)), 111.32 * 0.2, 0.1])
    assert one(spark, *[R.scale_bar_km(F.lit(w)) for w in (192.8, 25.0, 0.1, 90_000.0)]) == (20.0, 5.0, 0.1, 1000.0)


def test_table_rules(spark):
    f = spark.createDataFrame([("a", "sample", 10, True), ("a", "cov", 5, False), ("b", "cov", 7, False), (None, None, None, None)], "g string, role string, n long, ok boolean")
    assert tuple(R.role_summary(f, F.col("role"), {"samples": "sample", "covs": "cov"}, F.col("ok")).first()) == (4, 1, 2, 1)
    assert {r["g"]: r["rows_ready"] for r in R.rows_ready(f, ["g"], F.col("n"), F.col("ok")).collect()} == {"a": 10, "b": 0, None: 0}
    ready = R.readiness_gate(f, ["g"], F.col("role") == "sample", F.col("role") == "cov")
    assert {r["g"]: r["ready"] for r in ready.collect()} == {"a": True, "b": False, None: False}
    assert R.rows_ready(f.limit(0), [], F.col("n"), F.col("ok")).first()["rows_ready"] == 0
    assert R.status_rollup(f, ["g"], F.col("n"), F.col("ok")).count() == 4
    best = R.best_product(f.filter("g is not null"), ["g"], R.product_score(F.lit(1)), "n")
    assert {r["g"]: (r["n"], r["score"]) for r in best.collect()} == {"a": (5, 99), "b": (7, 99)}


def test_bands_and_strides(spark):
    b = spark.createDataFrame([(1, 1, 2019), (1, 2, 2020), (1, 3, 2020), (2, 1, None), (2, 2, 2018)], "f int, band int, y int")
    assert {r["f"]: r["band"] for r in R.choose_band(b, ["f"], "band", F.col("y"), 2020).collect()} == {1: 2, 2: 1}
    assert {r["f"]: r["band"] for r in R.choose_band(b, ["f"], "band", F.col("y"), None).collect()} == {1: 1, 2: 1}
    for rows, cols, most in ((36, 46, 1656), (36, 46, 100), (1, 500, 7), (0, 0, 5), (1000, 3, 10)):
        s = R.preview_stride(rows, cols, most)
        fits = lambda k: -(-rows // k) * -(-cols // k) <= most
        assert fits(s) and (s == 1 or not fits(s - 1))
    cells = spark.range(36).crossJoin(spark.range(46).toDF("col")).toDF("row", "col")
    assert R.downsample_stride(cells, 5).count() == 8 * 10


@pytest.mark.parametrize("ordered", [U.ORDERED, 10])
def test_ranked_value(spark, monkeypatch, ordered):
    monkeypatch.setattr(U, "ORDERED", ordered)
    monkeypatch.setattr(U, "RANK_PARTS", 4)
    r = np.random.default_rng(2)
    v = np.concatenate([r.lognormal(size=700), np.full(900, 1.5), [1e300, -1e-300]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for rank in (1, 2, 300, 801, 1400, len(v)):
        got = spark.range(1).select(U.ranked_value(df, "v", lambda n: F.lit(rank))).first()[0]
        assert got == np.sort(v)[rank - 1]
    assert spark.range(1).select(U.ranked_value(df.limit(0), "v", lambda n: n)).first()[0] is None


def test_band_tables(spark):
    read = lambda text: [(b["band"], b["feature"]) for b in one(spark, D.band_table(F.lit(text)))[0]]
    assert read("﻿Band,Feature_Name\r\n2,slope\r\n1, dem \r\n") == [(2, "slope"), (1, "dem")]
    assert read("note,name,band_index\nx,ndvi,3\ny,,4\nz,evi,0\nw,lst,q") == [(3, "ndvi")]
    assert read("波段,变量名\n1,som") == [(1, "som")]
    assert read("feature\ndem\n\nslope") == [(1, "dem"), (2, "slope")]
    assert read("a,b\n1,2") == [] and read("") == []
    assert one(spark, D.band_table(F.lit(None).cast("string")))[0] is None
