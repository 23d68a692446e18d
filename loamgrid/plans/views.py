"""Input views derived from the driver tables (see FIXTURES.md, part D).

Every view exists twice: as a DataFrame for Spark and as a CTE for the SQL check.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_TOP = 180000.0
#: The map's cells grow with the samples: at 500 times s * s samples a side of 5000 m is cut into s cells.
SAMPLES_PER_STEP = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores, for long work on each row: a table may be one row group, which one task reads."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


class Layout(NamedTuple):
    """Rows and columns of the map and the side of its cells in metres."""

    rows: int
    cols: int
    res: float


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    s = max(1, math.isqrt(table(spark, sf_dir, "part").count() // SAMPLES_PER_STEP))  # counted from the file footers
    return Layout(36 * s, 46 * s, 5000.0 / s)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    xi = ((k * 7919) % 2400).cast("double")
    yi = ((k * 104729) % 1600).cast("double")
    return table(spark, sf_dir, "part").select(
        k.alias("sample_id"),
        (xi * 95.0).alias("x"),
        (yi * 110.0).alias("y"),
        (F.lit(102.8) + xi / 1000.0).alias("lon"),
        (F.lit(29.9) + yi / 1000.0).alias("lat"),
        F.round(F.col("p_retailprice") / 50.0 + F.lit(0.2) * F.col("p_size") + xi / 800.0, 6).alias("som"),
        F.col("p_size").cast("double").alias("c_size"),
        ((k * 31) % 97).cast("double").alias("c_cyc"),
        F.when(k % 7 == 0, None).otherwise((k % 5).cast("double")).alias("c_zero"),
        ((k * 17) % 9 + 1).cast("int").alias("landcover"),
        (F.lit(1999) + (k % 4).cast("int")).alias("sample_year"),
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def whole(c: Column) -> Column:
        return F.floor(c).cast("bigint").cast("string")

    return samples(spark, sf_dir).select(
        "sample_id",
        F.concat(F.lit(" "), whole(F.col("lon") * 1000), F.lit(" m")).alias("lon_text"),
        F.when(F.col("sample_id") % 11 == 0, "n/a").otherwise(F.concat(whole(F.col("som")), F.lit(" g/kg"))).alias("som_text"),
        F.concat(F.lit("site-"), F.col("sample_year").cast("string"), F.lit(".csv")).alias("file_name"),
    )


def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers from one scan and one shuffle of ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    size = layout(spark, sf_dir)
    cells = li.groupBy(
        (F.col("l_orderkey") % size.rows).cast("int").alias("row"),
        (F.col("l_partkey") % size.cols).cast("int").alias("col"),
    ).agg(
        F.round(F.avg("l_quantity"), 6).alias("qty"),
        F.round(F.avg("l_discount") * 100, 6).alias("disc"),
        ((F.max("l_orderkey") + F.max("l_partkey")) % 9 + 1).cast("double").alias("class"),
    )
    return cells.select(
        "row",
        "col",
        F.explode(F.create_map(F.lit("qty"), F.col("qty"), F.lit("disc"), F.col("disc"), F.lit("class"), F.col("class"))).alias("layer", "value"),
    ).select("layer", "row", "col", "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = layout(spark, sf_dir)
    # One range over all cells: the planner knows its size, so a join does not take a large map for a small table and broadcast it.
    return (
        spark.range(size.rows * size.cols)
        .select(F.floor(F.col("id") / size.cols).cast("int").alias("row"), (F.col("id") % size.cols).cast("int").alias("col"))
        .withColumn("x", (F.col("col") + 0.5).cast("double") * size.res)
        .withColumn("y", F.lit(GRID_TOP) - (F.col("row") + 0.5).cast("double") * size.res)
    )


def block_of(x: str = "x", y: str = "y") -> Column:
    bx = F.least(F.floor(F.col(x) / 45600.0), F.lit(4)).cast("int")
    by = F.least(F.floor(F.col(y) / 35200.0), F.lit(4)).cast("int")
    return bx * 5 + by


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = samples(spark, sf_dir).withColumn("block", block_of())
    t = b.groupBy("block").agg(F.sum("som").alias("bs"), F.count("*").alias("bn"))
    tot = t.agg(F.struct(F.sum("bs").alias("ts"), F.sum("bn").alias("tn")).alias("tot"))
    means = t.withColumn("tot", tot.scalar()).select(
        "block", ((F.col("tot.ts") - F.col("bs")) / (F.col("tot.tn") - F.col("bn"))).alias("m")
    )
    return b.join(means, "block").select(
        "sample_id",
        "block",
        "x",
        "y",
        F.col("som").alias("y_true"),
        F.round("m", 6).alias("pred"),
        F.round(F.abs(F.col("som") - F.col("m")), 6).alias("abs_residual"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("seg_id"),
        (((k * 37) % 230).cast("double") * 1000.0).alias("x1"),
        (((k * 53) % 176).cast("double") * 1000.0).alias("y1"),
        (((k * 37 + 11) % 230).cast("double") * 1000.0).alias("x2"),
        (((k * 53 + 7) % 176).cast("double") * 1000.0).alias("y2"),
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "samples": (
        (),
        """select p_partkey as sample_id,
       cast((p_partkey * 7919) % 2400 as double) * 95.0::double as x,
       cast((p_partkey * 104729) % 1600 as double) * 110.0::double as y,
       102.8::double + cast((p_partkey * 7919) % 2400 as double) / 1000.0::double as lon,
       29.9::double + cast((p_partkey * 104729) % 1600 as double) / 1000.0::double as lat,
       round(p_retailprice / 50.0::double + 0.2::double * p_size + cast((p_partkey * 7919) % 2400 as double) / 800.0::double, 6) as som,
       cast(p_size as double) as c_size,
       cast((p_partkey * 31) % 97 as double) as c_cyc,
       case when p_partkey % 7 = 0 then null else cast(p_partkey % 5 as double) end as c_zero,
       cast((p_partkey * 17) % 9 + 1 as int) as landcover,
       1999 + cast(p_partkey % 4 as int) as sample_year
from part""",
    ),
    "raw_samples": (
        ("samples",),
        """select sample_id,
       concat(' ', cast(cast(floor(lon * 1000) as bigint) as varchar), ' m') as lon_text,
       case when sample_id % 11 = 0 then 'n/a' else concat(cast(cast(floor(som) as bigint) as varchar), ' g/kg') end as som_text,
       concat('site-', cast(sample_year as varchar), '.csv') as file_name
from samples""",
    ),
    "layout": (
        (),
        f"""select 36 * s as n_rows, 46 * s as n_cols, 5000.0::double / s as res from (select greatest(1, floor(sqrt(count(*) // {SAMPLES_PER_STEP})))::bigint as s from part)""",
    ),
    "raster_cells": (
        ("layout",),
        """select 'qty' as layer, cast(l_orderkey % (select n_rows from layout) as int) as "row", cast(l_partkey % (select n_cols from layout) as int) as "col", round(avg(l_quantity), 6) as "value"
from lineitem group by 1, 2, 3
union all
select 'disc', cast(l_orderkey % (select n_rows from layout) as int), cast(l_partkey % (select n_cols from layout) as int), round(avg(l_discount) * 100, 6)
from lineitem group by 1, 2, 3
union all
select 'class', cast(l_orderkey % (select n_rows from layout) as int), cast(l_partkey % (select n_cols from layout) as int), cast((max(l_orderkey) + max(l_partkey)) % 9 + 1 as double)
from lineitem group by 1, 2, 3""",
    ),
    "grid": (
        ("layout",),
        """select cast(r as int) as "row", cast(c as int) as "col", (c + 0.5::double) * res as x, 180000.0::double - (r + 0.5::double) * res as y
from (select unnest(range(0, n_rows)) as r from layout) r cross join (select unnest(range(0, n_cols)) as c from layout) c cross join layout""",
    ),
    "oof": (
        ("samples",),
        """select b.sample_id, b.block, b.x, b.y, b.som as y_true, round((a.ts - t.bs) / (a.tn - t.bn), 6) as pred,
       round(abs(b.som - (a.ts - t.bs) / (a.tn - t.bn)), 6) as abs_residual
from (select *, cast(least(floor(x / 45600.0), 4) as int) * 5 + cast(least(floor(y / 35200.0), 4) as int) as block from samples) b
join (select cast(least(floor(x / 45600.0), 4) as int) * 5 + cast(least(floor(y / 35200.0), 4) as int) as block, sum(som) as bs, count(*) as bn from samples group by 1) t
  on b.block = t.block cross join (select sum(som) as ts, count(*) as tn from samples) a""",
    ),
    "segments": (
        (),
        """select s_suppkey as seg_id, cast((s_suppkey * 37) % 230 as double) * 1000.0::double as x1, cast((s_suppkey * 53) % 176 as double) * 1000.0::double as y1,
       cast((s_suppkey * 37 + 11) % 230 as double) * 1000.0::double as x2, cast((s_suppkey * 53 + 7) % 176 as double) * 1000.0::double as y2
from supplier""",
    ),
}


def with_views(body: str, names: tuple[str, ...]) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def need(n: str) -> None:
        deps, _ = CTES[n]
        for d in deps:
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


# A wide training table: samples plus covariates averaged from the line items of each part.
CTES["wide"] = (
    ("samples",),
    """select s.*, f.f_qty, f.f_disc, f.f_tax, f.f_price from samples s left join
(select l_partkey, sum(l_quantity) / count(*) as f_qty, sum(cast(round(l_discount * 100) as bigint))::double / count(*)::double as f_disc,
 sum(cast(round(l_tax * 100) as bigint))::double / count(*)::double as f_tax, sum(cast(round(l_extendedprice * 100) as bigint))::double / count(*)::double as f_price
 from lineitem group by l_partkey) f on s.sample_id = f.l_partkey""",
)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            (F.sum("l_quantity") / F.count("*")).alias("f_qty"),
            *[
                (F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / F.count("*")).alias(f)
                for c, f in (("l_discount", "f_disc"), ("l_tax", "f_tax"), ("l_extendedprice", "f_price"))
            ],
        )
    )
    s = samples(spark, sf_dir)
    return s.join(f, s.sample_id == f.l_partkey, "left").drop("l_partkey")


# Areas: one triangle per nation, one enclosing area per region; boxes follow from the corners.
AREA_CORNERS = ((0.0, 0.0), (60000.0, 10000.0), (20000.0, 50000.0))
CTES["areas"] = (
    (),
    """select n_nationkey as area_id, n_name as name, r_name as parent, cast((n_nationkey * 9001) % 170000 as double) as ax, cast((n_nationkey * 57001) % 126000 as double) as ay
from nation join region on n_regionkey = r_regionkey""",
)
CTES["area_edges"] = (
    ("areas",),
    """select area_id, ax + dx1 as x1, ay + dy1 as y1, ax + dx2 as x2, ay + dy2 as y2 from areas cross join
(values (0.0::double, 0.0::double, 60000.0::double, 10000.0::double), (60000.0::double, 10000.0::double, 20000.0::double, 50000.0::double), (20000.0::double, 50000.0::double, 0.0::double, 0.0::double)) v(dx1, dy1, dx2, dy2)""",
)
CTES["inside"] = (
    ("samples", "area_edges"),
    """select sample_id, area_id from samples s cross join area_edges e group by sample_id, area_id
having sum(case when (y1 > s.y) <> (y2 > s.y) and s.x < x1 + (s.y - y1) * (x2 - x1) / (y2 - y1) then 1 else 0 end) % 2 = 1
 or bool_or(abs((s.x - x1) * (y2 - y1) - (s.y - y1) * (x2 - x1)) <= 1e-9 and s.x between least(x1, x2) and greatest(x1, x2) and s.y between least(y1, y2) and greatest(y1, y2))""",
)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("area_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("parent"),
        ((F.col("n_nationkey").cast("long") * 9001) % 170000).cast("double").alias("ax"),
        ((F.col("n_nationkey").cast("long") * 57001) % 126000).cast("double").alias("ay"),
    )
    ring = F.array(*[F.struct((F.col("ax") + dx).alias("x"), (F.col("ay") + dy).alias("y")) for dx, dy in AREA_CORNERS])
    from loamgrid.operators.raster import edges_of_ring

    return a.withColumn("edges", edges_of_ring(ring)).drop("ax", "ay")
