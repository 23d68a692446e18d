"""Every registered query against its SQL twin on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loamgrid.plans.views import CTES, grid, layout
from tools.check import TABLES, norm

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Compared at sf0.01 by tools/check.py; here a spread of cheap ones keeps the suite short.
FAST = [q for i, q in enumerate(sorted(ORACLE)) if i % 6 == 0]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 254


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    key = sorted(cols)
    want = sorted("|".join(norm(dict(zip(cols, r))[c]) for c in key) for r in cur.fetchall())
    got = sorted("|".join(norm(r[c]) for c in key) for r in (x.asDict(recursive=True) for x in df.collect()))
    assert got == want


@pytest.mark.parametrize("n, rows", [(0, 36), (499, 36), (1999, 36), (2000, 72), (4500, 108), (20_000, 216)])
def test_the_map_grows_with_the_samples(spark, tmp_path, n, rows):
    spark.range(n).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    size = layout(spark, str(tmp_path))
    assert size.rows == rows and tuple(size) == con.execute(CTES["layout"][1]).fetchone()
    assert grid(spark, str(tmp_path)).count() == size.rows * size.cols


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_cells"] for r in rows) == 36 * 46 and {r["risk"] for r in rows} <= {1, 2, 3, 4}
