"""Variograms and ordinary kriging of residuals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.operators.neighbors import _matrix, _Splits, _with_leaf, knn_reduce
from loamgrid.session import write_and_read

#: Points of a tile whose pairs are looked at together (for the range of distances, for sums), and nodes per axis that stand for a tile far away.
TILE, SMALL = 128, 64
NODES = 6
#: Tiles this many times farther apart than they are wide together are far.
FAR = 6.0
#: Most rows of a block of points; fewer where that spreads the pairs of blocks over more tasks.
BLOCK_ROWS, UNIT, BLOCKS = 1 << 18, 4096, 32
#: Bytes of distances that are looked at together, and pairs of tiles.
AT_ONCE, PAIRS_AT_ONCE = 1 << 19, 1 << 15


# ---------------------------------------------------------------- pair statistics


class _Level:
    """Tiles of one size: boxes, sums of ``f``, half diagonals and, once ``nodes`` was called, what their nodes weigh."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, total: np.ndarray):
        self.lo, self.hi, self.total = lo, hi, total
        self.mid, self.half = (lo + hi) / 2, (hi - lo) / 2
        self.r = np.sqrt((self.half**2).sum(axis=1))
        node = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
        self.nx, self.ny = self.mid[:, :1] + self.half[:, :1] * node, self.mid[:, 1:] + self.half[:, 1:] * node
        self.cosines = np.cos(np.outer(np.arccos(node), np.arange(NODES))) * np.where(np.arange(NODES), 2.0, 1.0) / NODES

    def share(self, v: np.ndarray, axis: int) -> np.ndarray:
        """What each node stands for at the values ``v`` (a row for each tile)."""
        half = self.half[:, axis, None]
        at = np.arccos(np.clip((v - self.mid[:, axis, None]) / np.where(half > 0, half, 1.0), -1, 1))
        return np.cos(at[:, :, None] * np.arange(NODES)) @ self.cosines.T


class _Tiles:
    """Points (x, y, z) as tiles of equal size, halved again and again across the wider axis; filled up with weight 0.

    ``f`` holds weight, weight of a known z, that times z and times z squared. ``levels`` are the tiles of every size, from one
    with all points down to those of at most ``tile``; the halves of tile i are 2 i and 2 i + 1 of the next level.
    """

    def __init__(self, p: np.ndarray, z0: float, tile: int = TILE):
        parts = 1 << max(0, math.ceil(math.log2(max(1, len(p)) / tile)))
        size = -(-len(p) // parts)
        short = parts * size - len(p)
        known = ~np.isnan(p[:, 2])
        z = np.where(known, p[:, 2] - z0, 0.0)
        q = np.column_stack([p[:, :2], np.ones(len(p)), known, z, z * z])
        q = np.concatenate([q, np.repeat(q[-1:] * [1, 1, 0, 0, 0, 0], short, axis=0)])[None]
        levels = [q]
        while q.shape[0] < parts:
            n, m = q.shape[0], q.shape[1]
            wide = np.ptp(q[:, :, :2], axis=1).argmax(axis=1)
            # Parts are halved evenly up to one row, so that all keep the same size.
            if m % 2:
                q, m = np.concatenate([q, q[:, -1:] * [1, 1, 0, 0, 0, 0]], axis=1), m + 1
            at = np.argpartition(np.take_along_axis(q[:, :, :2], wide[:, None, None], axis=2)[:, :, 0], m // 2, axis=1)
            q = np.take_along_axis(q, at[:, :, None], axis=1).reshape(2 * n, m // 2, 6)
            levels.append(q)
        self.x, self.y, self.f = q[:, :, 0], q[:, :, 1], np.ascontiguousarray(q[:, :, 2:])
        self.levels = [_Level(v[:, :, :2].min(axis=1), v[:, :, :2].max(axis=1), v[:, :, 2:].sum(axis=1)) for v in levels]
        self.lo, self.hi = self.levels[-1].lo, self.levels[-1].hi

    def nodes(self) -> None:
        """Weights ``w`` of the tiles' Chebyshev nodes: sums over points of a smooth function equal those over nodes.

        Those of a tile follow from the nodes of its halves.
        """
        low = self.levels[-1]
        low.w = np.einsum("ti,tim,tin->tmn", self.f[:, :, 0], low.share(self.x, 0), low.share(self.y, 1)).reshape(len(low.lo), -1)
        for up, low in zip(self.levels[-2::-1], self.levels[:0:-1]):
            n = len(up.lo)
            x, y = (up.share(v.reshape(n, -1), j).reshape(n, 2, NODES, NODES) for j, v in enumerate((low.nx, low.ny)))
            up.w = np.einsum("tcij,tcim,tcjn->tmn", low.w.reshape(n, 2, NODES, NODES), x, y, optimize=True).reshape(n, -1)


def _gaps(a: _Tiles, b: _Tiles, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance that points of two tiles can have."""
    near = np.maximum(0.0, np.maximum(a.lo[rows, None] - b.hi, b.lo - a.hi[rows, None]))
    far = np.maximum(a.hi[rows, None] - b.lo, b.hi - a.lo[rows, None])
    return np.sqrt((near * near).sum(axis=2)), np.sqrt((far * far).sum(axis=2))


def _dist(a: _Tiles, b: _Tiles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    dx, dy = a.x[i][:, :, None] - b.x[j][:, None], a.y[i][:, :, None] - b.y[j][:, None]
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def _pair_range(a: _Tiles, b: _Tiles, own: bool) -> tuple[float, float]:
    """Least and largest distance of the pairs; tiles that cannot change them are not looked at."""
    lo, hi = math.inf, -math.inf
    step = max(1, AT_ONCE // (8 * a.x.shape[1] * b.x.shape[1]))
    rows = max(1, AT_ONCE // (8 * len(b.lo)))
    for s in range(0, len(a.lo), rows):
        near, far = _gaps(a, b, slice(s, s + rows))
        live = np.arange(len(b.lo)) >= np.arange(s, s + len(near))[:, None] if own else np.ones(near.shape, bool)
        for by, ends in ((near, True), (-far, False)):
            i, j = np.nonzero(live & ((by < lo) if ends else (by < -hi)))
            order = np.argsort(by[i, j], kind="stable")
            i, j, key = i[order], j[order], by[i, j][order]
            for c in range(0, len(i), step):
                if key[c] >= (lo if ends else -hi):
                    break
                ii, jj = i[c : c + step] + s, j[c : c + step]
                d = _dist(a, b, ii, jj)
                use = (a.f[ii, :, 0][:, :, None] * b.f[jj, :, 0][:, None]) > 0
                if own:
                    use &= (ii != jj)[:, None, None] | np.triu(np.ones(d.shape[1:], bool), 1)
                lo, hi = min(lo, d.min(initial=math.inf, where=use)), max(hi, d.max(initial=-math.inf, where=use))
    return lo, hi


def _pair_stats(a: _Tiles, b: _Tiles, edges: np.ndarray, own: bool) -> np.ndarray:
    """Per lag class: pairs, sum of distances, sum of half squared differences.

    Two different blocks give every pair once; inside one block (``own``) a pair counts once. Classes are equally wide,
    the last edge may lie a little further out. Pairs of tiles are halved from the whole block on. Where all distances of
    two tiles are of one class and the tiles are far from each other, counts and squared differences follow from the
    tiles' sums and the distances from their nodes (the interpolation error is below 1e-9 of the distance there), so only
    pairs of tiles along the edges of classes are halved on. Pairs of the smallest tiles that are left are looked at one by one.
    """
    n, e0, step = len(edges) - 1, edges[0], edges[1] - edges[0]
    closed = edges[-1] > e0 + n * step
    acc = np.zeros((4, n + 2))  # pairs, pairs with both z, distances, half squares; the first and the last class are outside

    def put(cls, cnt, ok, d, g):
        at = np.clip(cls, -1, n).astype(np.int64) + 1
        if closed:
            at = np.minimum(at, n)
        for row, v in zip(acc, (cnt, ok, d, g)):
            row += np.bincount(at, v, n + 2)

    def moments(fa, u):
        """(pairs, pairs with both z, half squares) from one side's features and the other's sums."""
        return (fa[..., 0] * u[..., 0]), (fa[..., 1] * u[..., 1]), 0.5 * (fa[..., 3] * u[..., 1] + fa[..., 1] * u[..., 3]) - fa[..., 2] * u[..., 2]

    direct = max(1, AT_ONCE // (8 * a.x.shape[1] * b.x.shape[1]))
    nodes = max(1, AT_ONCE // (8 * NODES**4))
    tri = np.triu(np.ones((a.x.shape[1], b.x.shape[1])), 1)
    for t in {id(a): a, id(b): b}.values():
        t.nodes()

    def one_by_one(i, j, first, last):
        for c in range(0, len(i), direct):
            ii, jj = i[c : c + direct], j[c : c + direct]
            fa, fb = a.f[ii], b.f[jj]
            d = _dist(a, b, ii, jj)
            same = np.flatnonzero(ii == jj) if own else ()
            lo_, hi_ = np.maximum(first[c : c + direct], -1), np.minimum(last[c : c + direct], n)
            before = np.zeros((4, len(ii)))
            v = (d - e0) / step
            for k in range(int((hi_ - lo_).max(initial=0)) + 1):
                at = np.flatnonzero(lo_ + k <= hi_)  # classes up to this one
                whole = len(at) == len(ii)
                m = (v if whole else v[at]) < np.where(lo_[at] + k == hi_[at], np.inf, lo_[at] + k + 1.0)[:, None, None]
                m = m.astype(np.float64)
                for r in np.flatnonzero(np.isin(at, same)) if len(same) else ():
                    m[r] *= tri
                fa_, fb_ = (fa, fb) if whole else (fa[at], fb[at])
                cnt, ok, g = (x.sum(axis=1) for x in moments(fa_, np.matmul(m, fb_)))
                m *= d if whole else d[at]
                dist = (np.matmul(m, fb_[:, :, :1])[:, :, 0] * fa_[:, :, 0]).sum(axis=1)
                now = np.array([cnt, ok, dist, g])
                put(lo_[at] + k, *(now - before[:, at]))
                before[:, at] = now

    todo = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        if len(i) > PAIRS_AT_ONCE:
            todo.append((la, lb, i[PAIRS_AT_ONCE:], j[PAIRS_AT_ONCE:]))
            i, j = i[:PAIRS_AT_ONCE], j[:PAIRS_AT_ONCE]
        u, v = a.levels[la], b.levels[lb]
        gap = np.maximum(0.0, np.maximum(u.lo[i] - v.hi[j], v.lo[j] - u.hi[i]))
        reach = np.maximum(u.hi[i] - v.lo[j], v.hi[j] - u.lo[i])
        near, far, r = np.sqrt((gap * gap).sum(axis=1)), np.sqrt((reach * reach).sum(axis=1)), u.r[i] + v.r[j]
        first = np.floor((near - e0) / step - 1e-9).astype(np.int64)
        last = np.floor((far - e0) / step + 1e-9).astype(np.int64)
        live = (last >= 0) & (u.total[i, 0] > 0) & (v.total[j, 0] > 0)
        if not closed:
            live &= first < n
        place = live & (r == 0.0)  # two places, however many points they have
        at = np.flatnonzero(place)
        if len(at):
            ta, tb = u.total[i[at]], v.total[j[at]]
            cnt, ok, g = moments(ta, tb)
            twin = (i[at] == j[at]) & own
            cnt, ok, g = np.where(twin, (cnt - ta[:, 0]) / 2, cnt), np.where(twin, (ok - ta[:, 1]) / 2, ok), np.where(twin, g / 2, g)
            put(np.floor((near[at] - e0) / step), cnt, ok, near[at] * cnt, g)
        one = (first == last) | (closed & (np.minimum(first, n - 1) == np.minimum(last, n - 1)))
        sums = live & ~place & one & (near > FAR * r)
        at = np.flatnonzero(sums)
        for c in range(0, len(at), nodes):
            some = at[c : c + nodes]
            ii, jj = i[some], j[some]
            dx, dy = u.nx[ii][:, :, None] - v.nx[jj][:, None], u.ny[ii][:, :, None] - v.ny[jj][:, None]
            d = np.sqrt((dx * dx)[:, :, None, :, None] + (dy * dy)[:, None, :, None, :]).reshape(len(ii), NODES**2, -1)
            d = (np.matmul(d, v.w[jj][:, :, None])[:, :, 0] * u.w[ii]).sum(axis=1)
            cnt, ok, g = moments(u.total[ii], v.total[jj])
            put(first[some], cnt, ok, d, g)
        at = np.flatnonzero(live & ~place & ~sums)
        if la == len(a.levels) - 1 and lb == len(b.levels) - 1:
            one_by_one(i[at], j[at], first[at], last[at])
            continue
        if not len(at):
            continue
        i, j = i[at], j[at]
        ma, mb = (2 if la < len(a.levels) - 1 else 1), (2 if lb < len(b.levels) - 1 else 1)
        kids = [(ma * i + x, mb * j + y) for x in range(ma) for y in range(mb)]
        i, j = np.concatenate([x for x, _ in kids]), np.concatenate([y for _, y in kids])
        if own:
            i, j = i[i <= j], j[i <= j]
        todo.append((la + ma - 1, lb + mb - 1, i, j))
    out = acc[:, 1 : n + 1]
    return np.array([out[0], out[2], np.where(np.rint(out[0]) == np.rint(out[1]), out[3], np.nan)])


def _block_pairs(points: DataFrame, edges, reach: float | None = None) -> DataFrame:
    """Partial pair statistics of every pair of blocks of points.

    A k-d tree whose cuts come from a bounded sample cuts the points into blocks of nearby rows (a block above
    ``BLOCK_ROWS`` rows, at a hot place, further by a hash of the row). Every pair of blocks no farther apart than ``reach`` is one
    numpy task that returns one row per lag class: pairs are never emitted. ``edges`` None: the range of distances.
    """
    spark = points.sparkSession
    p = points.select(*(F.col(c).cast("double").alias(c) for c in ("id", "x", "y", "z"))).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    n = p.count()
    leaves = max(1, min(-(-n // UNIT), max(BLOCKS, -(-n // BLOCK_ROWS))))
    share = min(1.0, leaves * 64 / max(1, n))
    p = p.withColumn("v", F.array("x", "y"))
    some = p.filter(F.pmod(F.xxhash64("id", "x", "y"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow() if leaves > 1 else None  # about 64 rows a leaf
    splits = spark.sparkContext.broadcast(_Splits(_matrix(some.column("v"), 2) if some is not None and some.num_rows else np.empty((0, 2)), leaves))
    p = _with_leaf(p, "v", "point", splits, "leaf").drop("v")
    size = p.groupBy("leaf").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{e}") for c in ("x", "y") for f, e in ((F.min, 0), (F.max, 1)))).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS)).toArrow()  # a row for each leaf
    units = [(r["leaf"] << 20 | i, r["x0"], r["x1"], r["y0"], r["y1"]) for r in size.to_pylist() for i in range(r["parts"])]
    gap = lambda a, b: math.hypot(max(0.0, a[1] - b[2], b[1] - a[2]), max(0.0, a[3] - b[4], b[3] - a[4]))
    pairs = [(a[0], b[0], i * len(units) + j) for i, a in enumerate(units) for j, b in enumerate(units) if i <= j and (reach is None or gap(a, b) <= reach)]
    meet = F.broadcast(spark.createDataFrame(pairs, "u long, v long, pair long"))  # pairs of blocks
    parts = F.broadcast(spark.createDataFrame([(r["leaf"], r["parts"]) for r in size.to_pylist()], "leaf long, parts long"))
    p = p.join(parts, "leaf").select(F.shiftleft("leaf", 20).bitwiseOR(F.pmod(F.xxhash64("id", "x", "y"), F.col("parts"))).alias("b"), "x", "y", "z")
    sides = lambda c, side: p.join(meet, F.col("b") == F.col(c)).select("pair", F.lit(side).alias("side"), "x", "y", "z")
    rows = sides("u", 0).unionByName(sides("v", 1).join(F.broadcast(spark.createDataFrame([(i * len(units) + i,) for i in range(len(units))], "pair long")), "pair", "left_anti"))
    schema = "lo double, hi double" if edges is None else "lag int, n double, d double, g double"

    def stats(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        m = np.column_stack([t.column(c).to_numpy() for c in ("x", "y", "z")])
        z0 = np.nanmean(m[:, 2]) if not np.isnan(m[:, 2]).all() else 0.0
        own = not (side == 1).any()
        tile = TILE if edges is None else SMALL
        a = _Tiles(m[side == 0], z0, tile)
        b = a if own else _Tiles(m[side == 1], z0, tile)
        if edges is None:
            lo, hi = _pair_range(a, b, own)
            return pa.table({"lo": [float(lo)], "hi": [float(hi)]})
        acc = _pair_stats(a, b, edges, own)
        return pa.table({"lag": pa.array(np.arange(acc.shape[1]), pa.int32()), "n": acc[0], "d": acc[1], "g": acc[2]})

    # A pair of blocks is little data and much work, so its tasks are not joined by their bytes.
    return rows.repartition(max(1, min(len(pairs), 4 * spark.sparkContext.defaultParallelism)), "pair").groupBy("pair").applyInArrow(stats, schema)


def lag_pairs(points: DataFrame, width: float, max_lag: float) -> DataFrame:
    """Pairs closer than ``max_lag`` by lag class of fixed width: count, mean distance, mean half squared difference."""
    edges = np.arange(0.0, max_lag + width / 2, width)
    return _lag_rows(_block_pairs(points, edges, reach=max_lag))


def _lag_rows(parts: DataFrame) -> DataFrame:
    # A sum over tiles may miss a whole number by its rounding.
    s = parts.groupBy("lag").agg(F.round(F.sum("n")).cast("long").alias("pairs"), F.sum("d").alias("d"), F.sum("g").alias("g")).filter("pairs > 0")
    return s.select("lag", "pairs", (F.col("d") / F.col("pairs")).alias("mean_dist"), (F.col("g") / F.col("pairs")).alias("gamma"))


def variogram_bins(points: DataFrame, nlags: int = 6) -> DataFrame:
    """Equal-width lag classes over the full distance range (the last one closed); none for fewer than two points."""
    points = write_and_read(points.select("id", "x", "y", "z"), "points")  # read for the range and for the sums
    r = _block_pairs(points, None).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if r["lo"] is None or not math.isfinite(r["lo"]):
        return points.sparkSession.createDataFrame([], "lag int, pairs long, mean_dist double, gamma double")
    step = (r["hi"] - r["lo"]) / nlags or 1.0
    edges = np.array([r["lo"] + i * step for i in range(nlags)] + [r["hi"] + 0.001])
    return write_and_read(_lag_rows(_block_pairs(points, edges)), "lags")  # ``nlags`` rows; a fit reads them several times


# ---------------------------------------------------------------- model


#: Exponents of the power form are tried up to here; below 2 the form stays a valid variogram.
MAX_EXPONENT = 1.999
MODELS = ("spherical", "exponential", "gaussian", "linear", "power")
#: The sill may exceed the largest semivariance by this factor; the slopes of the open forms are free.
SILL_FACTOR = {"linear": 1e9, "power": 1e9}


def shape_column(model: str, h: Column, rng: Column, exponent: Column) -> Column:
    """A model at distance h without nugget and for a sill of one (effective range 3 for the exponential, 7/4 for the gaussian form)."""
    t = h / rng
    if model == "spherical":
        return F.when(t <= 1.0, 1.5 * t - 0.5 * t * t * t).otherwise(1.0)
    if model == "exponential":
        return 1.0 - F.exp(-3.0 * t)
    if model == "gaussian":
        return 1.0 - F.exp(-(1.75 * t) * (1.75 * t))
    return t if model == "linear" else F.pow(t, exponent)


def gamma_numpy(model: str, h: np.ndarray, nugget: float, psill: float, rng: float, exponent: float = 1.5) -> np.ndarray:
    t = h / rng
    if model == "spherical":
        t = np.minimum(t, 1.0)
        return psill * (1.5 * t - 0.5 * t**3) + nugget
    if model == "exponential":
        return psill * (1.0 - np.exp(-3.0 * t)) + nugget
    if model == "gaussian":
        return psill * (1.0 - np.exp(-((1.75 * t) ** 2))) + nugget
    return psill * (t if model == "linear" else t**exponent) + nugget


def lag_weights(bins: DataFrame, weighted: bool) -> DataFrame:
    """Bins as (h, g, w): a logistic weight that falls from one to zero around 0.7 of the lags' range, or one everywhere."""
    h = F.col("mean_dist")
    ends = bins.agg(F.struct(F.min("mean_dist").alias("lo"), F.max("mean_dist").alias("hi"))).scalar()
    b = bins.withColumn("__e", ends)
    width = F.col("__e.hi") - F.col("__e.lo")
    # The curve's middle at 0.7 of the range, and 0.9 and 0.1 one tenth of the range beside it.
    w = 1.0 / (1.0 + F.exp(-(2.1972 / (0.1 * width)) * (0.7 * width + F.col("__e.lo") - h)))
    return b.select(h.alias("h"), F.col("gamma").alias("g"), F.when(F.lit(weighted) & (width > 0), w).otherwise(1.0).alias("w"))


def variogram_fit(bins: DataFrame, models=MODELS, steps: int = 400, weighted: bool = False) -> DataFrame:
    """Bounded weighted least squares per model: nugget, psill, range, exponent and the weighted squared error.

    For a given range every model is linear in nugget and sill, so their best values within the bounds (nugget up to the
    largest semivariance, sill up to ten times that) follow in closed form: the free optimum where it lies
    inside, else the best point of the four edges. The range runs over ``steps`` values up to the largest lag; the linear
    form has none, and the power form's exponent runs up to 1.999 instead (its range is the largest lag). Ties go to
    the smaller range or exponent. The bins, one row per lag class, travel as one array; candidates are scored in place.
    """
    arr = lag_weights(bins, weighted).agg(F.array_sort(F.collect_list(F.struct("h", "g", "w"))).alias("b"))
    c = arr.select("b", F.array_max(F.transform("b", lambda p: p["g"])).alias("gmax"), F.array_max(F.transform("b", lambda p: p["h"])).alias("dmax"))
    span = lambda m: F.struct(F.lit(m).alias("model"), F.lit(steps if m == "linear" else 1).alias("first"), F.lit(SILL_FACTOR.get(m, 10.0)).alias("factor"))
    c = c.select("*", F.inline(F.array(*[span(m) for m in models]))).select("*", F.explode(F.sequence("first", F.lit(steps))).alias("i"))
    share = F.col("i") / float(steps)
    c = c.withColumn("range", F.when(F.col("model").isin("linear", "power"), F.col("dmax")).otherwise(F.col("dmax") * share))
    c = c.withColumn("exponent", F.when(F.col("model") == "power", MAX_EXPONENT * share)).withColumn("top", F.col("gmax") * F.col("factor"))

    def shape(p):
        out = None
        for m in models:
            f = shape_column(m, p["h"], F.col("range"), F.col("exponent"))
            out = F.when(F.col("model") == m, f) if out is None else out.when(F.col("model") == m, f)
        return F.struct(out.alias("f"), p["g"].alias("g"), p["w"].alias("w"))

    c = c.filter("dmax > 0").withColumn("p", F.transform("b", shape))
    total = lambda fn: F.aggregate("p", F.lit(0.0), lambda a, p: a + fn(p))
    c = c.select(
        "model", "i", "range", "exponent", "gmax", "top", "p", total(lambda p: p["w"]).alias("sw"), total(lambda p: p["w"] * p["f"]).alias("sf"), total(lambda p: p["w"] * p["f"] * p["f"]).alias("sff"),
        total(lambda p: p["w"] * p["g"]).alias("sg"), total(lambda p: p["w"] * p["f"] * p["g"]).alias("sfg"),
    )
    sw, sf, sff, sg, sfg, top, gmax = (F.col(n) for n in ("sw", "sf", "sff", "sg", "sfg", "top", "gmax"))
    zero = F.lit(0.0)
    within = lambda v, hi: F.least(F.greatest(F.coalesce(v, zero), zero), hi)
    det = sw * sff - sf * sf
    free = F.try_divide(sw * sfg - sf * sg, F.when(det > 1e-9 * sw * sff, det))
    nugget = (sg - free * sf) / sw
    inside = (nugget >= 0) & (nugget <= gmax) & (free >= 0) & (free <= top)
    at = lambda n, s, ok=None: F.struct((n if ok is None else F.when(ok, n)).alias("nugget"), s.alias("psill"))
    options = F.array(
        at(nugget, free, inside), at(zero, within(F.try_divide(sfg, sff), top)), at(gmax, within(F.try_divide(sfg - gmax * sf, sff), top)),
        at(within(sg / sw, gmax), zero), at(within((sg - top * sf) / sw, gmax), top),
    )
    c = c.select("model", "i", "range", "exponent", "gmax", "p", F.posexplode(options).alias("edge", "v")).filter(F.col("v.nugget").isNotNull())
    err = F.aggregate("p", F.lit(0.0), lambda a, p: a + p["w"] * F.pow(F.col("v.nugget") + F.col("v.psill") * p["f"] - p["g"], F.lit(2.0)))
    c = c.withColumn("sse", err).withColumn("size", F.round(F.coalesce(F.try_divide(F.col("sse"), F.col("gmax") * F.col("gmax")), F.lit(0.0)), 10))
    best = c.groupBy("model").agg(F.min(F.struct("size", "i", "edge", "v", "range", "exponent", "sse")).alias("s"))
    return best.select("model", "s.v.nugget", "s.v.psill", "s.range", "s.exponent", "s.sse")


def fitted(points: DataFrame, model: str = "spherical", nlags: int = 6, weighted: bool = False) -> dict | None:
    """The fit of one model as kriging takes it; None where all points lie at one place."""
    r = variogram_fit(variogram_bins(points, nlags), [model], weighted=weighted).first()
    return r and {k: r[k] for k in ("model", "nugget", "psill", "range")} | {"exponent": r["exponent"] or 1.5}


def merge_places(points: DataFrame, value: str = "z", item_id: str = "id") -> DataFrame:
    """One point per place: mean value, smallest id, ``n_merged``. Coinciding points would make kriging systems
    singular and crowd out the neighbourhood. Points without a value or a place are left out."""
    ok = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull())
    return ok.groupBy("x", "y").agg(F.avg(value).alias(value), F.min(item_id).alias(item_id), F.count("*").alias("n_merged"))


def krige_local(targets: DataFrame, points: DataFrame, vario: dict, k: int = 16, exclude_self: str | None = None, value: str = "z", **kw) -> DataFrame:
    """Adds ``krig`` and ``krig_var`` from the k nearest points: one (k+1) system per target, solved in batches.

    ``vario`` holds model, nugget, psill, range and, for the power form, exponent. A singular system falls back to the neighbour
    mean and sets ``fallback``. Points at one place count as one (``merge_places``), so the result
    does not depend on ids; with ``exclude_self`` the points must be merged already.
    """
    if exclude_self is None:
        points = merge_places(points, value, kw.get("item_id", "sample_id"))
    pts = points.withColumn("px", F.col("x").cast("double")).withColumn("py", F.col("y").cast("double"))
    if targets is points:
        targets = pts

    def solve(d, c):
        parts = [_solve_batch(c[s : s + 2048, :, 0], c[s : s + 2048, :, 1], c[s : s + 2048, :, 2], d[s : s + 2048], vario) for s in range(0, len(d), 2048)]
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0), np.empty(0), np.empty(0, dtype=bool)]

    fields = [T.StructField("krig", T.DoubleType()), T.StructField("krig_var", T.DoubleType()), T.StructField("fallback", T.BooleanType())]
    return knn_reduce(targets, pts, k, solve, fields, carry=["px", "py", value], self_id=exclude_self, **kw).drop(*([] if targets is not pts else ["px", "py"]))


def _solve_batch(px, py, z, d0, vario):
    n, m = px.shape
    g = lambda h: gamma_numpy(vario["model"], h, vario["nugget"], vario["psill"], vario["range"], vario.get("exponent", 1.5))
    d = np.sqrt((px[:, :, None] - px[:, None, :]) ** 2 + (py[:, :, None] - py[:, None, :]) ** 2)
    a = np.ones((n, m + 1, m + 1))
    a[:, :m, :m] = np.where(d <= 1e-10, 0.0, g(d))
    a[:, m, m] = 0.0
    eye = np.arange(m)
    a[:, eye, eye] = 0.0
    rhs = np.ones((n, m + 1))
    rhs[:, :m] = np.where(d0 <= 1e-10, 0.0, g(d0))
    bad = np.zeros(n, dtype=bool)
    try:
        w = np.linalg.solve(a, rhs[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        w = np.full((n, m + 1), np.nan)
        for i in range(n):
            ai = a[i].copy()
            ai[eye, eye] += 1e-10
            try:
                w[i] = np.linalg.solve(ai, rhs[i])
            except np.linalg.LinAlgError:
                pass
    # Coinciding points make the system singular or nearly so; such rows use the neighbour mean.
    bad = ~np.isfinite(w).all(axis=1) | (np.abs(w[:, :m]).max(axis=1) > 1e6)
    est = np.where(bad, z.mean(axis=1), (w[:, :m] * z).sum(axis=1))
    var = np.where(bad, np.nan, (w * rhs).sum(axis=1))
    return est, var, bad


def variogram_quality(points: DataFrame, vario: dict, k: int = 16, **kw) -> DataFrame:
    """Leave-one-place-out: q1 (mean standardised error, wants 0), q2 (mean square, wants 1), cr, and the score; 1.0 when unknown."""
    points = merge_places(points)
    c = krige_local(points, points, vario, k, exclude_self="id", item_id="id", **kw)
    ok = c.filter(~F.col("fallback") & (F.col("krig_var") > 1e-12))
    e = (F.col("krig") - F.col("z")) / F.sqrt("krig_var")
    s = ok.agg(F.count("*").alias("n"), F.avg(e).alias("q1"), F.avg(e * e).alias("q2"), F.exp(F.avg(F.log("krig_var"))).alias("gm"))
    s = s.withColumn("cr", F.col("q2") * F.col("gm"))
    score = F.abs("q1") + F.abs(F.col("q2") - 1.0) + 0.01 * F.abs("cr")
    return s.select("n", "q1", "q2", "cr", F.coalesce(score, F.lit(1.0)).alias("score"))
