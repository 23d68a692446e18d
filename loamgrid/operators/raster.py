"""Raster cells as tables: stacks, sampling, alignment, masks, windows, grids and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.session import cut_lineage


def feature_stack(cells: DataFrame, layers: list[str], keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """One column per layer on one grid: one shuffle with map-side partial aggregation."""
    agg = [F.max(F.when(F.col("layer") == l, F.col("value"))).alias(l) for l in layers]
    return cells.filter(F.col("layer").isin(layers)).groupBy(*keys).agg(*agg)


def cell_of(x: Column, y: Column, x0: Column | float, y0: Column | float, res: Column | float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point; rows count down from the top."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.floor((as_col(y0) - y) / as_col(res)).cast("int"), F.floor((x - as_col(x0)) / as_col(res)).cast("int")


def sample_at_points(points: DataFrame, cells: DataFrame, layers: list[str], x0: float, y0: float, res: float) -> DataFrame:
    """Adds one column per layer with the value of the cell under each point.

    Only cells under a point are stacked (a semi join on the distinct places of points comes first), and all layers
    share one equi join on (row, col). Points outside the grid or without a place find no partner.
    """
    row, col = cell_of(F.col("x"), F.col("y"), x0, y0, res)
    p = points.withColumn("row", row).withColumn("col", col)
    under = cells.join(p.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return p.join(feature_stack(under, layers), ["row", "col"], "left")


def align_nearest(cells: DataFrame, grid: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Value of the source cell under each target cell centre."""
    row, col = cell_of(F.col("x"), F.col("y"), x0, y0, res)
    g = grid.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), row.alias("row"), col.alias("col"))
    return g.join(cells.select("row", "col", "value"), ["row", "col"], "left").select(
        F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value"
    )


def align_bilinear(cells: DataFrame, grid: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Weighted mean of the four cells around each target centre, over those with a value."""
    fx = (F.col("x") - F.lit(x0)) / F.lit(res) - 0.5
    fy = (F.lit(y0) - F.col("y")) / F.lit(res) - 0.5
    g = grid.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), fx.alias("fx"), fy.alias("fy"))
    c0, r0 = F.floor("fx"), F.floor("fy")
    tx, ty = F.col("fx") - c0, F.col("fy") - r0
    corner = [
        F.struct((r0 + dr).cast("int").alias("row"), (c0 + dc).cast("int").alias("col"), ((ty if dr else 1 - ty) * (tx if dc else 1 - tx)).alias("w"))
        for dr in (0, 1)
        for dc in (0, 1)
    ]
    e = g.select("t_row", "t_col", F.inline(F.array(*corner)))
    j = e.filter(F.col("w") > 0).join(cells.select("row", "col", "value"), ["row", "col"]).filter(F.col("value").isNotNull())
    return j.groupBy(F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def focal_stats(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Window mean, minimum, maximum and count around each cell.

    Separable: every cell is sent to the 2r+1 rows it reaches and partially aggregated, then
    the same along columns, so a 5x5 window costs 10 copies per cell and not 25.
    """
    off = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    v = cells.filter(F.col("value").isNotNull())
    rows = v.select("layer", "row", "col", "value", off.alias("d")).groupBy("layer", (F.col("row") + F.col("d")).alias("row"), "col").agg(
        F.sum("value").alias("s"), F.count("*").alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx")
    )
    win = rows.select("layer", "row", "col", "s", "n", "mn", "mx", off.alias("d")).groupBy("layer", "row", (F.col("col") + F.col("d")).alias("col")).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("mn").alias("focal_min"), F.max("mx").alias("focal_max")
    )
    win = win.select("layer", "row", "col", (F.col("s") / F.col("n")).alias("focal_mean"), "focal_min", "focal_max", "n")
    return cells.join(win, ["layer", "row", "col"], "left")


def terrain_windows(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Position index, roughness and relief of a height layer."""
    f = focal_stats(cells, radius)
    return f.withColumn("tpi", F.col("value") - F.col("focal_mean")).withColumn("relief", F.col("focal_max") - F.col("focal_min"))


def laplacian(cells: DataFrame) -> DataFrame:
    """Sum of the four neighbours minus four times the cell, where all five have values."""
    arms = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    e = cells.select("layer", "row", "col", "value", F.inline(arms))
    w = F.when((F.col("dr") == 0) & (F.col("dc") == 0), -4.0).otherwise(1.0)
    s = e.groupBy("layer", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(
        F.count("value").alias("n"), F.sum(w * F.col("value")).alias("lap")
    )
    return s.filter(F.col("n") == 5).select("layer", "row", "col", "lap")


# ---------------------------------------------------------------- grids and polygons


def make_grid(bounds: Column, res: float, spark_df: DataFrame) -> DataFrame:
    """Cells of the bounds snapped outward to ``res``; rows from the top, no cell limit.

    ``spark_df`` has one row from which ``bounds`` (struct xmin, ymin, xmax, ymax) is read. Rows
    are generated first and spread, so columns are exploded in parallel.
    """
    b = spark_df.select(bounds.alias("b")).select(
        (F.floor(F.col("b.xmin") / res) * res).alias("x0"),
        (F.ceil(F.col("b.ymax") / res) * res).alias("y0"),
        F.greatest(F.lit(1), F.ceil(F.col("b.xmax") / res) - F.floor(F.col("b.xmin") / res)).cast("int").alias("w"),
        F.greatest(F.lit(1), F.ceil(F.col("b.ymax") / res) - F.floor(F.col("b.ymin") / res)).cast("int").alias("h"),
    )
    rows = b.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")).repartition("row")
    return rows.select("row", "x0", "y0", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col")).select(
        "row",
        "col",
        (F.col("x0") + (F.col("col") + 0.5) * res).cast("double").alias("x"),
        (F.col("y0") - (F.col("row") + 0.5) * res).cast("double").alias("y"),
    )


def edges_of_ring(ring: Column) -> Column:
    """Closed or open ring (array of x,y structs) -> array of edge structs."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(ring, i)["x"].alias("x1"),
            F.get(ring, i)["y"].alias("y1"),
            F.get(ring, (i + 1) % n)["x"].alias("x2"),
            F.get(ring, (i + 1) % n)["y"].alias("y2"),
        ),
    )


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd crossing count, or the point lies on an edge."""

    def crosses(e):
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] == e["y1"], None).otherwise(e["y2"] - e["y1"])
        return straddles & F.coalesce(x < at, F.lit(False))

    def on(e):
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (F.abs(cross) <= 1e-9) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        )

    return (F.size(F.filter(edges, crosses)) % 2 == 1) | F.exists(edges, on)


def area_index(areas: DataFrame, tile: float) -> DataFrame:
    """(tile_x, tile_y, area) for every tile an area's box touches: turns containment into an equi join."""
    box = lambda f, a, b: f(F.transform("edges", lambda e: F.least(e[a], e[b]) if f is F.array_min else F.greatest(e[a], e[b])))
    b = (
        areas.withColumn("bx0", box(F.array_min, "x1", "x2"))
        .withColumn("by0", box(F.array_min, "y1", "y2"))
        .withColumn("bx1", box(F.array_max, "x1", "x2"))
        .withColumn("by1", box(F.array_max, "y1", "y2"))
    )
    seq = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    return b.withColumn("tile_x", F.explode(seq("bx0", "bx1"))).withColumn("tile_y", F.explode(seq("by0", "by1")))


def polygon_join(points: DataFrame, areas: DataFrame, tile: float = 25000.0, how: str = "inner", x: str = "x", y: str = "y") -> DataFrame:
    """Points within or on an area, by tile equi join, box test and crossing test.

    Where the two sides are small Spark broadcasts the areas by their size; otherwise the
    tile key shuffles and AQE splits a hot tile. Areas are not exploded per point.
    """
    idx = area_index(areas, tile)
    p = points.withColumn("tile_x", F.floor(F.col(x) / tile)).withColumn("tile_y", F.floor(F.col(y) / tile))
    inside = (
        F.col(x).between(F.col("bx0"), F.col("bx1"))
        & F.col(y).between(F.col("by0"), F.col("by1"))
        & contains_point(F.col("edges"), F.col(x), F.col(y))
    )
    a = idx.withColumnRenamed("tile_x", "__tx").withColumnRenamed("tile_y", "__ty")
    cond = (p["tile_x"] == a["__tx"]) & (p["tile_y"] == a["__ty"]) & inside
    return p.join(a, cond, how).drop("tile_x", "tile_y", "__tx", "__ty", "bx0", "by0", "bx1", "by1", "edges")


def edge_connected(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Background cells joined to the raster edge by 4-neighbour steps.

    Runs of background cells in a row are the nodes, overlapping runs of neighbouring rows the
    edges. Minimum labels spread by hooking and by pointer jumping (every round each label is
    replaced by its own label), so the number of rounds grows with the logarithm of the longest
    path. The label table is checkpointed every round.
    """
    w = Window.partitionBy("row").orderBy("col")
    runs = cells.select("row", "col").withColumn("g", F.col("col") - F.row_number().over(w))
    runs = runs.groupBy("row", "g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = runs.withColumn("id", F.col("row").cast("long") * cols + F.col("c0"))
    runs = cut_lineage(runs.select("id", "row", "c0", "c1"))
    up = runs.select(F.col("id").alias("id2"), (F.col("row") + 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    pairs = runs.join(up, "row").filter((F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1"))).select("id", "id2")
    links = cut_lineage(pairs.unionByName(pairs.select(F.col("id2").alias("id"), F.col("id").alias("id2"))))
    lab = runs.select("id", F.col("id").alias("lab"))
    while True:
        near = links.join(lab.select(F.col("id").alias("id2"), F.col("lab").alias("l2")), "id2").groupBy("id").agg(F.min("l2").alias("l2"))
        nxt = lab.join(near, "id", "left").select("id", "lab", F.least("lab", "l2").alias("new"))
        jump = nxt.select(F.col("id").alias("new"), F.col("new").alias("far"))
        nxt = nxt.join(jump, "new", "left").select("id", "lab", F.least("new", "far").alias("new"))
        nxt = cut_lineage(nxt)
        changed = nxt.filter(F.col("new") < F.col("lab")).limit(1).count()
        lab = nxt.select("id", F.col("new").alias("lab"))
        if not changed:
            break
    touching = (F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("c0") == 0) | (F.col("c1") == cols - 1)
    full = runs.join(lab, "id")
    hit = full.filter(touching).select("lab").distinct()
    return full.join(hit, "lab", "left_semi").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
