"""Known results: missing values, resolutions, band names, progress."""

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import text as X
from loamgrid.functions.register import register
from loamgrid.operators import schema as S
from loamgrid.operators.aggregates import coarsest_resolution
from loamgrid.sources import documents as D


@pytest.mark.parametrize(
    "value,nodata,masked,policy,reason",
    [
        (0.0, None, False, "never", None),
        (0.0, 0.0, False, "never", None),
        (0.0, 0.0, True, "never", None),
        (0.0, 0.0, False, "metadata", "nodata"),
        (1e31, None, False, "never", "extreme_fill_value"),
        (float("nan"), None, False, "never", "nonfinite"),
        (-9999.0, -9999.0, False, "never", "nodata"),
        (5.0, -9999.0, True, "never", "masked"),
        (None, -9999.0, False, "never", "non_numeric"),
    ],
)
def test_missing_reason(spark, value, nodata, masked, policy, reason):
    df = spark.createDataFrame([(value, nodata, "slope", masked)], "v double, nd double, name string, m boolean")
    assert df.select(C.missing_reason(*[F.col(c) for c in df.columns], policy)).first()[0] == reason


@pytest.mark.parametrize("level,evidence,want", [("city", 250.0, 250.0), ("city", 30.0, 250.0), ("county", 30.0, 30.0), ("city", 500.0, 500.0), ("country", None, 1000.0)])
def test_resolution(spark, level, evidence, want):
    df = spark.createDataFrame([(evidence, level)], "coarsest double, level string")
    assert coarsest_resolution(df, F.col("level")).first()["resolution"] == want


def test_band_names(spark):
    doc = '{"1": "DEM_point_m", "2": "slope_250m_deg", "3": "zero_valid_test"}'
    df = spark.createDataFrame([(doc, ["a", "", "c"])], "doc string, d array<string>")
    n = D.band_names(df, F.lit(3), D.band_map(F.col("doc")), F.col("d"), F.lit("stack")).orderBy("band").collect()
    assert [r["name"] for r in n] == ["DEM_point_m", "slope_250m_deg", "zero_valid_test"]
    assert {r["source"] for r in n} == {"companion_mapping_file"}
    e = D.band_names(df, F.lit(3), F.array().cast("array<struct<band:int,feature:string>>"), F.col("d"), F.lit("stack")).orderBy("band").collect()
    assert [r["name"] for r in e] == ["a", "stack_band_02", "c"]


def test_progress(spark):
    lines = ["V170 Clean RFK 正在评分候选参数 6/24", "[MODEL] V170 可出图特征RFK候选参数 12/24 完成", "noise", "任务成功完成"]
    got = [r[0] for r in spark.createDataFrame([(l,) for l in lines], "l string").select(X.progress_of(F.col("l"))).collect()]
    assert got[0] >= 59 and got[1] >= 76 and got[2] is None and got[3] == 99


def test_core_fields():
    f = S.infer_core_fields(["OM (g/kg)", "lon_wgs84", "纬度", "climate_x"])
    assert f == {"lon": "lon_wgs84", "lat": "纬度", "som": "OM (g/kg)"}
    assert S.find_field(["land土壤有机质含量x"], ["土壤有机质"]) == "land土壤有机质含量x"
    with pytest.raises(ValueError):
        S.infer_core_fields(["lon", "lat"])
    assert S.is_leak_column("coord_x", "som") and S.is_leak_column("som", "som") and not S.is_leak_column("slope", "som")


def test_sql_names(spark):
    register(spark)
    r = spark.sql(
        "select dist2d(0d, 0d, 3d, 4d) d, extract_numeric('a -1.5e2 %') n, strip_admin_suffix('成都市') s, strip_admin_suffix('市') t, "
        "weighted_quantile(array(3d, 1d, 2d), array(1d, 1d, 8d), 0.5d) w"
    ).first()
    assert (r["d"], r["n"], r["s"], r["t"], r["w"]) == (5.0, -150.0, "成都", "市", 2.0)
    g = spark.sql("select * from grid_cells(0d, 0d, 25d, 15d, 10d)").collect()
    assert len(g) == 6 and (g[0]["x"], g[0]["y"]) == (5.0, 15.0)


def test_weighted_quantile_column(spark):
    from loamgrid.functions.quantile import weighted_quantile

    df = spark.sql("select array(named_struct('v', 3d, 'w', 1d), named_struct('v', 1d, 'w', 1d), named_struct('v', 2d, 'w', 8d), named_struct('v', 0d, 'w', 0d)) as p")
    assert [df.select(weighted_quantile(F.col("p"), q)).first()[0] for q in (0.0, 0.1, 0.11, 0.9, 0.95)] == [1.0, 1.0, 2.0, 2.0, 3.0]
