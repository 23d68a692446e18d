"""Projections against arc lengths, conformality, equal areas and their own inverses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import projection as P
from loamgrid.operators.schema import project_metric


def arc(lat0, lat1, steps=20000):
    """Length of a meridian by Simpson's rule."""
    phi = np.radians(np.linspace(lat0, lat1, steps + 1))
    f = P.SEMI_MAJOR * (1 - P.E2) / (1 - P.E2 * np.sin(phi) ** 2) ** 1.5
    return (phi[1] - phi[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def rows(spark, places, crs):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id int, lon double, lat double")
    return [(r["mx"], r["my"]) for r in project_metric(df, crs).orderBy("id").collect()]


def radii(lat):
    s = 1 - P.E2 * math.sin(math.radians(lat)) ** 2
    return P.SEMI_MAJOR * (1 - P.E2) / s**1.5, P.SEMI_MAJOR / math.sqrt(s) * math.cos(math.radians(lat))


def test_central_meridian(spark):
    got = rows(spark, [(105, v) for v in (0, 10, 45, 60, 84, -30)], "EPSG:32648")
    for (e, n), lat in zip(got, (0, 10, 45, 60, 84, -30)):
        assert abs(e - 500000) < 1e-6 and abs(n - math.copysign(0.9996 * arc(0, abs(lat)), lat)) < 1e-5


def test_utm_is_conformal_and_albers_keeps_areas(spark):
    places = [(102.3, 29.9), (107.9, 3.0), (104.0, -41.0), (106.5, 70.0)]
    h = 1e-4
    cross = [(lon + dx, lat + dy) for lon, lat in places for dx, dy in ((h, 0), (-h, 0), (0, h), (0, -h))]
    for crs in ("EPSG:32648", P.Albers(25, 47, 0, 105)):
        p = np.array(rows(spark, cross, crs)).reshape(len(places), 4, 2)
        for (lon, lat), q in zip(places, p):
            m, c = radii(lat)
            east, north = (q[0] - q[1]) / (2 * math.radians(h) * c), (q[2] - q[3]) / (2 * math.radians(h) * m)
            if crs == "EPSG:32648":
                assert np.allclose([north[1], -north[0]], east, atol=1e-8)
            else:
                assert abs(east[0] * north[1] - east[1] * north[0] - 1) < 1e-8


def test_round_trips_below_a_millimetre(spark):
    g = np.random.default_rng(5)
    places = [(x, y) for x, y in zip(g.uniform(102, 108, 500), g.uniform(-80, 84, 500))] + [(105, 0), (102, 0), (105, 89.9)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id int, lon double, lat double")
    u = project_metric(df, "EPSG:32648")
    cone = P.Albers(25, 47, 0, 105, 4e5, -1e5)
    a = project_metric(df.filter("lat > -40"), cone)
    for d, (lon, lat) in ((u, P.utm_inverse(F.col("mx"), F.col("my"), F.lit(48))), (a, cone.inverse(F.col("mx"), F.col("my")))):
        err = d.select(((lon - F.col("lon")) * F.cos(F.radians("lat"))).alias("x"), (lat - F.col("lat")).alias("y")).select(F.max(F.abs("x")), F.max(F.abs("y"))).first()
        assert max(err) * 111320 < 1e-4


def test_bad_places_and_codes(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (181.0, 1.0), (1.0, 90.5), (float("inf"), 0.0)], "lon double, lat double")
    for crs in ("utm", "EPSG:32648", P.Albers(25, 47, 0, 105)):
        assert all(r["mx"] is None and r["my"] is None for r in project_metric(df, crs).collect())
    assert [r[0] for r in spark.createDataFrame([(-180.0,), (-174.0,), (179.9,), (180.0,)], "lon double").select(P.utm_zone(F.col("lon"))).collect()] == [1, 2, 60, 1]
    assert P.parse_crs("epsg:32748") == (48, True)
    for code in ("EPSG:4326", "EPSG:32600", "EPSG:32661", "48N"):
        with pytest.raises(ValueError):
            P.parse_crs(code)
    with pytest.raises(ValueError):
        P.Albers(30, -30, 0, 0).cone
