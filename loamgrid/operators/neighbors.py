"""Exact k-nearest-neighbour joins without a cross join.

Items (points or line segments) are tiled by k-d packing: parts are halved across their
widest axis, whatever the number of axes. Every tile keeps its bounding box and row count.
For a block of nearby targets, an exact search of the closest tiles gives an upper bound on
the k-th distance, and only tiles whose lower bound does not exceed it are searched.
Nothing is dropped, so the result is exact.

Two layouts share the numpy kernel:

* the item table has at most ``broadcast_rows`` rows (checked first): the tiled items are
  broadcast and the targets are mapped in place, with no shuffle and no skew;
* otherwise a k-d tree cuts items and targets into units of bounded size. Boxes and counts of units bound the k-th
  distance of nearby targets; where the units within that bound are little data, they are gathered with a chunk of targets
  in one task, which searches and reduces them, so no neighbour list is shuffled or stored. Elsewhere (many axes, targets
  far from all items) a search of a target's own unit bounds its k-th distance, and only units within that bound are
  searched for it. Units lie as files in the shared folder, and a task reads those its targets need one after another, so
  neither items nor targets are sent for a pair of units.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.session import scratch_path, write_and_read
from loamgrid.sources import blobs

# A layout choice, not a limit: more items, in rows or bytes, are searched unit by unit with the same result.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 250_000
MAX_TILES = 65_536
SAMPLE_PER_LEAF = 8
UNIT_ROWS = 4_096
#: Leaves (a power of two) and target rows of a chunk that one task searches, its most bytes of items, and targets that are reduced together.
CHUNK_LEVELS, CHUNK_ROWS, CHUNK_BYTES, CHUNK_BLOCK = 4, 1 << 16, 64 << 20, 1 << 13
BLOCK = 256
GATHER = 1 << 17  # neighbours of the targets that are searched at once in the broadcast layout: the more targets, the smaller the box of a block
NEAR_BLOCK = 64  # targets searched together; small boxes keep the candidate tiles few
WIDE_AXES, WIDE_BLOCK, WIDE_ROWS = 8, 512, 32  # from so many axes on boxes exclude little: larger blocks, and distances by matrix products of so many targets
BOUND_ROWS = 256  # targets of one matrix product once their k-th distances have a bound


# ---------------------------------------------------------------- numpy kernels


def _distances(t: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """Distance matrix targets x items; terms are added axis by axis, left to right."""
    if kind == "segment":
        x1, y1, x2, y2 = (c[None, :, j] for j in range(4))
        px, py = t[:, 0:1], t[:, 1:2]
        dx, dy = x2 - x1, y2 - y1
        ll = dx * dx + dy * dy
        u = ((px - x1) * dx + (py - y1) * dy) / np.where(ll > 0, ll, 1.0)
        u = np.clip(u, 0.0, 1.0)
        ex, ey = px - (x1 + u * dx), py - (y1 + u * dy)
        return np.sqrt(ex * ex + ey * ey)
    acc = np.zeros((len(t), len(c)))
    for j in range(t.shape[1]):
        d = t[:, j : j + 1] - c[None, :, j]
        acc += d * d
    return np.sqrt(acc)


def _top_k(d: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest entries per row, ordered by (distance, column).

    Callers sort the columns by item id, so equal distances come out in id order.
    """
    n = d.shape[1]
    if n <= k:
        return np.argsort(d, axis=1, kind="stable")
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    pick.sort(axis=1)
    val = np.take_along_axis(d, pick, axis=1)
    order = np.argsort(val, axis=1, kind="stable")
    pick, kth = np.take_along_axis(pick, order, axis=1), val.max(axis=1)
    tied = np.flatnonzero((d <= kth[:, None]).sum(axis=1) > k)
    if len(tied):
        dt = d[tied]
        m = min(n, int((dt <= kth[tied][:, None]).sum(axis=1).max()))
        wide = np.argpartition(dt, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(np.arange(n), dt.shape).copy()
        wide.sort(axis=1)
        first = np.argsort(np.take_along_axis(dt, wide, axis=1), axis=1, kind="stable")[:, :k]
        pick[tied] = np.take_along_axis(wide, first, axis=1)
    return pick


def _nearest(t: np.ndarray, c: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(column numbers, distances) of the k nearest items per target, as ``_top_k`` of ``_distances`` has them.

    In many axes a matrix product gives squared distances up to its rounding; only items that this cannot exclude are
    measured axis by axis, so the result is the same.
    """
    if kind == "point" and t.shape[1] >= WIDE_AXES and len(c) > 8 * k:
        mid = c.mean(axis=0)
        b = c - mid
        bb = np.einsum("ij,ij->i", b, b)
        # Far above the rounding of sums of so many axes, of the centring and of the product.
        unit = 1e-15 * (t.shape[1] + 16)
        top = bb.max() + np.einsum("ij,ij->i", c, c).max()
        picks, dists = [], []
        for s in range(0, len(t), WIDE_ROWS):
            some = t[s : s + WIDE_ROWS]
            a = some - mid
            aa = np.einsum("ij,ij->i", a, a)
            rough = a @ (-2.0 * b.T)
            rough += bb
            rough += aa[:, None]
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            m = (rough <= (kth + 4.0 * unit * (aa + np.einsum("ij,ij->i", some, some) + top))[:, None]).sum(axis=1).max()
            if not k <= m <= max(64, len(c) // 8):  # too many alike, or numbers beyond the product's range
                d = _distances(some, c, kind)
                pick = _top_k(d, k)
                d = np.take_along_axis(d, pick, axis=1)
            else:
                near = np.argpartition(rough, m - 1, axis=1)[:, :m]
                near.sort(axis=1)
                d = np.zeros(near.shape)
                for j in range(t.shape[1]):
                    step = some[:, j : j + 1] - c[near, j]
                    d += step * step
                d = np.sqrt(d)
                first = _top_k(d, k)
                pick, d = np.take_along_axis(near, first, axis=1), np.take_along_axis(d, first, axis=1)
            picks.append(pick)
            dists.append(d)
        if picks:
            return np.concatenate(picks), np.concatenate(dists)
    d = _distances(t, c, kind)
    pick = _top_k(d, k)
    return pick, np.take_along_axis(d, pick, axis=1)


class _Wide:
    """Items in many axes, for targets whose k-th distances have a bound.

    A matrix product in single precision tells which items can lie within the bound of a target; its tolerance is far above
    the rounding, and only those pairs are measured axis by axis, so the distances are those of ``_distances``.
    """

    def __init__(self, c: np.ndarray):
        self.c, self.mid = c, c.mean(axis=0)
        b = c - self.mid
        bb = np.einsum("ij,ij->i", b, b)
        self.near, self.far = bb.max(), np.einsum("ij,ij->i", c, c).max()
        with np.errstate(over="ignore", invalid="ignore"):
            self.b = np.vstack([-2.0 * b.T, bb]).astype(np.float32)

    def within(self, t: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target, item, distance) of all pairs no farther apart than the bound of the target, by target and item."""
        found = []
        for s in range(0, len(t), BOUND_ROWS):
            some, most = t[s : s + BOUND_ROWS], bound[s : s + BOUND_ROWS]
            a = some - self.mid
            aa, tt = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", some, some)
            slack = 4.0 * (t.shape[1] + 16) * (2.0**-24 * (aa + self.near) + 1e-15 * (tt + self.far)) + 1e-35
            limit = most * most * (1.0 + 1e-9) - aa + slack
            pairs = None
            if max(aa.max() + self.near, tt.max() + self.far, np.abs(limit).max()) < 1e30:  # otherwise beyond single precision
                rough = np.column_stack([a, np.ones(len(a))]).astype(np.float32) @ self.b
                pairs = np.flatnonzero(rough <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])
            if pairs is None or len(pairs) > len(some) * len(self.c) // 8:
                d = _distances(some, self.c, "point")
                row, item = np.nonzero(d <= most[:, None])
                d = d[row, item]
            else:
                row, item = np.divmod(pairs, len(self.c))
                d = np.zeros(len(pairs))
                for j in range(t.shape[1]):
                    step = some[row, j] - self.c[item, j]
                    d += step * step
                d = np.sqrt(d)
                ok = d <= most[row]
                row, item, d = row[ok], item[ok], d[ok]
            found.append((row + s, item, d))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _boxes(c: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "segment":
        lo = np.minimum(c[:, :2], c[:, 2:])
        return lo, np.maximum(c[:, :2], c[:, 2:])
    return c, c


def _anchor(c: np.ndarray, kind: str) -> np.ndarray:
    return (c[:, :2] + c[:, 2:]) / 2.0 if kind == "segment" else c


def _tile_order(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row order and tile start offsets of a k-d packing: parts are halved across their widest axis."""
    n = len(a)
    order = np.arange(n)
    starts: list[int] = []
    stack = [(0, n)] if n else []
    while stack:
        s, e = stack.pop()
        if e - s <= size:
            starts.append(s)
            continue
        part = order[s:e]
        x = a[part]
        axis = int((x.max(axis=0) - x.min(axis=0)).argmax())
        half = size * max(1, (e - s) // (2 * size))
        order[s:e] = part[np.argpartition(x[:, axis], half)]
        stack += [(s, s + half), (s + half, e)]
    return order, np.sort(np.asarray(starts, dtype=int))


class _Index:
    """Bounded item table, tiled; broadcast as plain arrays."""

    def __init__(self, coords: np.ndarray, ids: np.ndarray, carry: np.ndarray, kind: str, size: int | None = None):
        self.block = WIDE_BLOCK if kind == "point" and coords.shape[1] >= WIDE_AXES else NEAR_BLOCK
        # Segments are packed by both ends: one long segment among short ones would widen the box of its tile.
        order, starts = _tile_order(coords, size or self.block)
        self.kind, self.coords, self.ids, self.carry = kind, coords[order], ids[order], carry[order]
        self.starts = starts
        self.ends = np.append(starts[1:], len(order)) if len(starts) else starts
        blo, bhi = _boxes(self.coords, kind)
        self.lo = np.minimum.reduceat(blo, starts) if len(starts) else blo
        self.hi = np.maximum.reduceat(bhi, starts) if len(starts) else bhi
        self.n = self.ends - self.starts
        self.searched = 0

    def _tiles_for(self, tb: np.ndarray, k: int) -> np.ndarray:
        """Tiles that may hold one of the k nearest: an exact search of the closest tiles gives the bound for all."""
        lo, hi = tb.min(axis=0), tb.max(axis=0)
        near = np.maximum(0.0, np.maximum(self.lo - hi, lo - self.hi))
        dmin = np.sqrt((near * near).sum(axis=1))
        away = ((self.lo + self.hi - lo - hi) ** 2).sum(axis=1)
        by = np.lexsort((away, dmin))
        first = by[: int(np.searchsorted(np.cumsum(self.n[by]), k)) + 1]
        items = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in first])
        if len(items) <= k:
            return np.arange(len(dmin))
        d = _distances(tb, self.coords[items], self.kind)
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] * (1.0 + 1e-9) + 1e-9
        kept = np.flatnonzero(dmin <= bound.max())
        gap = np.maximum(0.0, np.maximum(self.lo[kept] - tb[:, None], tb[:, None] - self.hi[kept]))
        return kept[(np.sqrt((gap * gap).sum(axis=2)) <= bound[:, None]).any(axis=0)]

    def search(self, t: np.ndarray, k: int):
        """Yields (target rows, distances, item rows) per block of nearby targets."""
        order, starts = _tile_order(t, self.block)
        for s, e in zip(starts, np.append(starts[1:], len(order))):
            rows = order[s:e]
            tb = t[rows]
            tiles = self._tiles_for(tb, k)
            self.searched += len(tiles)
            cand = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in tiles])
            cand = cand[np.argsort(self.ids[cand], kind="stable")]
            pick, d = _nearest(tb, self.coords[cand], k, self.kind)
            yield rows, d, cand[pick]


def _matrix(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def _neighbor_array(dist: np.ndarray, ids: np.ndarray, carry: np.ndarray, names: list[str]) -> pa.ListArray:
    n, k = dist.shape
    fields = [pa.array(dist.ravel()), pa.array(ids.ravel())] + [pa.array(carry[..., j].ravel()) for j in range(len(names))]
    values = pa.StructArray.from_arrays(fields, ["dist", "id", *names])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), values)


# ---------------------------------------------------------------- public operator


def _neighbor_type(carry: list[str]) -> T.ArrayType:
    f = [T.StructField("dist", T.DoubleType()), T.StructField("id", T.LongType())]
    return T.ArrayType(T.StructType(f + [T.StructField(c, T.DoubleType()) for c in carry]))


def knn_join(targets: DataFrame, items: DataFrame, k: int, *, carry: list[str] = (), out: str = "neighbors", **kw) -> DataFrame:
    """Adds ``out``: the k nearest items of every target as an array ordered by (dist, id).

    ``target_coords`` and ``item_coords`` are column names or one ``array<double>`` column;
    ``item_id`` names the item key, ``carry`` item columns to bring along. ``kind='segment'``
    takes four item coordinates (x1, y1, x2, y2). Rows with a missing coordinate have no
    distance: such items are left out, such targets get an empty array.
    """
    return _search(targets, items, k, list(carry), None, [T.StructField(out, _neighbor_type(list(carry)))], **kw)


def knn_reduce(targets: DataFrame, items: DataFrame, k: int, reduce, fields: list[T.StructField], *, carry: list[str] = (), self_id: str | None = None, **kw) -> DataFrame:
    """Adds ``fields`` computed from the k nearest items without building neighbour lists.

    ``reduce(dist, carry)`` gets arrays of shape (targets, k) and (targets, k, columns) and
    returns one array per field. ``self_id`` leaves out the item whose id equals that target
    column. Targets without a place get NULL.
    """
    return _search(targets, items, k, list(carry), reduce, fields, self_id=self_id, **kw)


def _search(
    targets, items, k, carry, reduce, fields, *, target_coords=("x", "y"), item_coords=("x", "y"), item_id="sample_id", kind="point",
    broadcast_rows=None, self_id=None,
) -> DataFrame:
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    as_vec = lambda c: c if isinstance(c, Column) else F.array(*[F.col(n).cast("double") for n in c])
    complete = lambda c: ~F.exists(c, lambda v: v.isNull() | F.isnan(v)) & c.isNotNull()
    it = items.select(
        as_vec(item_coords).cast("array<double>").alias("__v"),
        F.col(item_id).cast("long").alias("__id"),
        *[F.col(c).cast("double").alias(c) for c in carry],
    ).filter(complete(F.col("__v")))
    first = None if isinstance(item_coords, (tuple, list)) else it.select(F.size("__v")).first()
    axes = len(item_coords) if isinstance(item_coords, (tuple, list)) else first[0] if first else 1
    if kind == "segment" and broadcast_rows is None:
        limit = BROADCAST_BYTES  # boxes of units of segments overlap, so only their bytes count
    limit = min(limit, BROADCAST_BYTES // (8 * (axes + len(carry) + 2)))
    head = it.limit(limit + 1).toArrow()  # one job: the whole table when it is within the limit
    n, small = head.num_rows, head.num_rows <= limit
    if not small:
        n = it.count()
    width = len(head.column("__v")[0].as_py()) if head.num_rows else 2
    want = min(k, max(1, n - (1 if self_id else 0)))
    find = min(n, want + (1 if self_id else 0))
    tv = as_vec(target_coords).cast("array<double>")
    none = F.array_repeat(F.lit(float("nan")), 2 if kind == "segment" else width)
    tg = targets.withColumn("__t", F.when(complete(tv), tv).otherwise(none))
    if n == 0:
        return tg.select(*targets.columns, *[(F.array() if reduce is None else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    if targets is items and small:
        # The targets are the counted items: cheap to spread when they come from one small file.
        tg = tg.repartition(max(1, min(tg.sparkSession.sparkContext.defaultParallelism, n // BLOCK)))
    finish = _finisher(carry, reduce, fields, want, self_id)
    if small:
        return _mapped(tg, head, find, width, carry, kind, fields, finish)
    return _by_units(tg, it, find, n, width, carry, kind, fields, finish)


def _finisher(carry, reduce, fields, want, self_id):
    """Turns (batch, rows with a place, distances, ids, carried values) into the new columns."""

    def finish(batch, good, dist, ids, cv):
        if reduce is None:
            arr = _neighbor_array(dist, ids, cv, carry)
            if not good.all():  # targets without a place keep an empty list
                ends = np.concatenate([[0], np.cumsum(np.where(good, dist.shape[1], 0))])
                arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), arr.values)
            return [arr]
        if self_id and len(dist):
            me = batch.column(self_id).to_numpy(zero_copy_only=False)[good]
            rest = np.argsort(ids == me[:, None], axis=1, kind="stable")[:, :want]
            dist, cv = np.take_along_axis(dist, rest, axis=1), np.take_along_axis(cv, rest[:, :, None], axis=1)
        cols = []
        for f, v in zip(fields, reduce(dist, cv)):
            if v.dtype == bool:
                full = np.zeros(len(good), dtype=bool)
                full[good] = v
                cols.append(pa.array(full, mask=~good))
            else:
                full = np.full(len(good), np.nan)
                full[good] = v
                cols.append(pa.array(full, from_pandas=True))
        return cols

    return finish


def _mapped(tg, tbl, k, width, carry, kind, fields, finish) -> DataFrame:
    n = tbl.num_rows  # at most the broadcast limit
    cols = [tbl.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in carry]
    cv = np.stack(cols, axis=1).astype("float64") if cols else np.empty((n, 0))
    ix = _Index(_matrix(tbl.column("__v"), width), tbl.column("__id").combine_chunks().to_numpy(), cv, kind)
    shared = tg.sparkSession.sparkContext.broadcast(ix)
    tdim = 2 if kind == "segment" else width
    keep = [f for f in tg.schema.fields if f.name != "__t"]
    schema = T.StructType(keep + fields)

    def gathered(batches):
        some, rows = [], 0
        for b in batches:
            some.append(b)
            rows += b.num_rows
            if rows * k >= GATHER:
                yield pa.concat_batches(some)
                some, rows = [], 0
        if rows:
            yield pa.concat_batches(some)

    def search(batches):
        idx = shared.value
        for b in gathered(batches):
            t = _matrix(b.column("__t"), tdim)
            good = ~np.isnan(t).any(axis=1)
            ok = t[good]
            dist = np.zeros((len(ok), k))
            rows = np.zeros((len(ok), k), dtype=int)
            for r, d, p in idx.search(ok, k):
                dist[r], rows[r] = d, p
            data = [b.column(f.name) for f in keep] + finish(b, good, dist, idx.ids[rows], idx.carry[rows])
            yield pa.RecordBatch.from_arrays(data, names=schema.names)

    return tg.mapInArrow(search, schema)


def _applied(found, carry, fields, finish, k) -> DataFrame:
    """The same last step over neighbour lists that came out of the paired layout."""
    if fields[0].dataType == _neighbor_type(carry):
        return found.withColumnRenamed("__nn", fields[0].name)
    keep = [f for f in found.schema.fields if f.name != "__nn"]
    schema = T.StructType(keep + fields)

    def apply(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            nn = b.column("__nn")
            good = np.asarray(nn.value_lengths()) > 0
            flat = nn.flatten()
            m = lambda c: flat.field(c).to_numpy(zero_copy_only=False).reshape(-1, k)
            cv = np.stack([m(c) for c in carry], axis=2) if carry else np.empty((int(good.sum()), k, 0))
            data = [b.column(f.name) for f in keep] + finish(b, good, m("dist"), m("id"), cv)
            yield pa.RecordBatch.from_arrays(data, names=schema.names)

    return found.mapInArrow(apply, schema)


class _Splits:
    """A complete k-d tree over a sample of anchors: every node halves its part of the sample across the widest axis.

    Only the cuts come from the sample; each row has exactly one leaf, and leaf boxes and counts are taken from all rows.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        nodes = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(nodes, dtype=int), np.full(nodes, np.inf)
        parts = [sample]
        for node in range(nodes):  # in order of levels, so each part is there when its node is reached
            x, parts[node] = parts[node], None
            left = right = x[:0]
            if len(x) > 1:
                axis = int((x.max(axis=0) - x.min(axis=0)).argmax())
                v = np.sort(x[:, axis])
                half = v[(len(v) - 1) // 2]
                self.axis[node], self.cut[node] = axis, half if half < v[-1] else np.nextafter(half, -np.inf)
                up = x[:, axis] > self.cut[node]
                left, right = x[~up], x[up]
            else:
                left = x
            parts += [left, right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def _with_leaf(df: DataFrame, column: str, kind: str, shared, out: str) -> DataFrame:
    """Adds the leaf of every row of ``df``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.LongType())])

    def run(batches):
        splits = shared.value
        for b in batches:
            if b.num_rows:
                x = _anchor(_matrix(b.column(column), len(b.column(column)[0])), kind)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.leaf(x))], names=schema.names)

    return df.mapInArrow(run, schema)


def _leaves_for(t: np.ndarray, bound: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Per target the leaves whose box is no farther than its bound; nearby targets are looked at together."""
    out: list = [None] * len(t)
    order, starts = _tile_order(t, NEAR_BLOCK)
    limit = bound * (1.0 + 1e-9) + 1e-9
    box = lambda rows, at: np.maximum(0.0, np.maximum(lo[at] - t[rows].max(axis=0), t[rows].min(axis=0) - hi[at]))
    reach = lambda rows, at: at[np.sqrt((box(rows, at) ** 2).sum(axis=1)) <= limit[rows].max()]
    close = reach(order, np.arange(len(lo))) if len(t) else np.empty(0, dtype=int)
    for s, e in zip(starts, np.append(starts[1:], len(order))):
        rows = order[s:e]
        at = reach(rows, close)
        gap = np.maximum(0.0, np.maximum(lo[at] - t[rows][:, None], t[rows][:, None] - hi[at]))
        for r, hit in zip(rows, np.sqrt((gap * gap).sum(axis=2)) <= limit[rows][:, None]):
            out[r] = at[hit]
    return out


def _far_bound(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of the k-th distance from leaf boxes and counts alone."""
    out = np.empty(len(t))
    for i, p in enumerate(t):
        far = np.sqrt((np.maximum(np.abs(hi - p), np.abs(p - lo)) ** 2).sum(axis=1))
        by = np.argsort(far, kind="stable")
        out[i] = far[by[min(int(np.searchsorted(np.cumsum(n[by]), k)), len(by) - 1)]]
    return out


def _nearest_lists(lt: pa.Table, rt: pa.Table, k: int, tdim: int, width: int, carry: list[str], kind: str):
    """Targets, their k-th distances and neighbour lists within the given items, by blocks of targets."""
    t = _matrix(lt.column("__t"), tdim)
    c, ids = _matrix(rt.column("__v"), width), rt.column("__id").combine_chunks().to_numpy()
    cols = [rt.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in carry]
    cv = np.stack(cols, axis=1).astype("float64") if cols else np.empty((len(ids), 0))
    by_id = np.argsort(ids, kind="stable")
    c, ids, cv = c[by_id], ids[by_id], cv[by_id]
    for s in range(0, len(t), BLOCK):
        tb = t[s : s + BLOCK]
        p, d = _nearest(tb, c, min(k, len(ids)), kind)
        yield tb, d[:, -1] if len(ids) >= k else np.full(len(tb), np.inf), _neighbor_array(d, ids[p], cv[p], carry)


def _renewed(df: DataFrame) -> DataFrame:
    """New column identities, so that a frame can be cogrouped with one it was joined with."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _points(t: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1]), pa.int32()), pa.array(t.ravel()))


def _item_leaves(it, k, n, width, carry, kind) -> tuple[DataFrame, object, pa.Table]:
    """Items with their ``__leaf`` (written), the broadcast cuts, and rows and box of every leaf.

    Items are cut by a k-d tree whose cuts halve a sample of bounded size (``SAMPLE_PER_LEAF`` rows a leaf).
    """
    tdim = 2 if kind == "segment" else width
    # Of items at one place only the k smallest ids can matter: bounds a hot place.
    w = Window.partitionBy("__v").orderBy("__id")
    it = it.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    leaves = min(MAX_TILES, math.ceil(n / UNIT_ROWS))
    share = min(1.0, leaves * SAMPLE_PER_LEAF / n)
    some = it.filter(F.pmod(F.xxhash64("__id", "__v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("__v").toArrow()  # about leaves * SAMPLE_PER_LEAF rows
    splits = it.sparkSession.sparkContext.broadcast(_Splits(_anchor(_matrix(some.column("__v"), width), kind) if some.num_rows else np.empty((0, tdim)), leaves))
    low = lambda v, j: F.least(F.get(v, F.lit(j)), F.get(v, F.lit(j + 2))) if kind == "segment" else F.get(v, F.lit(j))
    high = lambda v, j: F.greatest(F.get(v, F.lit(j)), F.get(v, F.lit(j + 2))) if kind == "segment" else F.get(v, F.lit(j))
    it = write_and_read(_with_leaf(it, "__v", kind, splits, "__leaf"), "items")  # read for the boxes, in the first pass and in the search
    return it, splits, _leaf_boxes(it, [low(F.col("__v"), j) for j in range(tdim)], [high(F.col("__v"), j) for j in range(tdim)])


def _leaf_boxes(df: DataFrame, low: list[Column], high: list[Column]) -> pa.Table:
    """Leaf, rows, least and largest coordinates: at most 2 * MAX_TILES rows."""
    return df.groupBy("__leaf").agg(F.count("*").alias("n"), F.array(*map(F.min, low)).alias("lo"), F.array(*map(F.max, high)).alias("hi")).toArrow()


def _by_units(tg, it, k, n, width, carry, kind, fields, finish) -> DataFrame:
    """The targets with their new columns, for more items than are broadcast.

    Targets are cut into leaves like the items. For all targets of a leaf, the boxes of item leaves bound the k-th distance
    from above and tell which leaves can matter. The targets of some neighbouring leaves are a chunk (of ``CHUNK_ROWS`` rows;
    more are dealt by a hash of the row), and its items are sent to it once for each leaf. Chunks whose items are more
    bytes than ``CHUNK_BYTES``, or than their targets' partial lists would be, go through ``_paired``.
    """
    spark = tg.sparkSession
    tdim = 2 if kind == "segment" else width
    it, splits, meta = leaves = _item_leaves(it, k, n, width, carry, kind)
    placed = _with_leaf(tg, "__t", "point", splits, "__cut").withColumn("__leaf", F.when(~F.exists("__t", F.isnan), F.col("__cut")).otherwise(-1)).drop("__cut")
    placed = write_and_read(placed.withColumn("__row", F.monotonically_increasing_id()), "targets")  # read for the boxes and in the search
    tg = placed.select(*tg.columns)  # as written: everything in it may be null
    at = lambda j: F.get("__t", F.lit(j))
    boxes = _leaf_boxes(placed, [at(j) for j in range(tdim)], [at(j) for j in range(tdim)])
    parallel = spark.sparkContext.defaultParallelism
    levels = max(0, min(CHUNK_LEVELS, int(math.log2(max(1, boxes.num_rows / (4 * parallel))))))
    shared = spark.sparkContext.broadcast((meta.column("__leaf").to_numpy(), _matrix(meta.column("lo"), tdim), _matrix(meta.column("hi"), tdim), meta.column("n").to_numpy()))
    item_bytes, most = 8 * (width + len(carry)) + 20, CHUNK_BYTES // (8 * (width + len(carry) + 1))

    def needed(batches):
        leaf, lo, hi, rows = shared.value
        for b in batches:
            tlo, thi, own = _matrix(b.column("lo"), tdim), _matrix(b.column("hi"), tdim), b.column("__leaf").to_numpy()
            for t0, t1, o in zip(tlo, thi, own):
                gap = np.maximum(0.0, np.maximum(lo - t1, t0 - hi))
                reach = np.maximum(np.abs(hi - t0), np.abs(t1 - lo))
                far = np.sqrt((reach * reach).sum(axis=1))
                by = np.argsort(far, kind="stable")
                bound = far[by[min(int(np.searchsorted(np.cumsum(rows[by]), k)), len(by) - 1)]]
                near = np.sqrt((gap * gap).sum(axis=1)) <= bound * (1.0 + 1e-9) + 1e-9
                got = leaf[near] if rows[near].sum() <= most else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), o >> levels)), pa.array(got)], ["__chunk", "__leaf"])

    some = boxes.filter(pa.array(boxes.column("__leaf").to_numpy() >= 0))
    need = spark.createDataFrame(some.select(["__leaf", "lo", "hi"])).repartition(max(1, min(some.num_rows, 4 * parallel))).mapInArrow(needed, "__chunk bigint, __leaf bigint") if some.num_rows else spark.createDataFrame([], "__chunk bigint, __leaf bigint")
    need = write_and_read(need.distinct(), "chunk-leaves")
    size = spark.createDataFrame(meta.select(["__leaf", "n"]))
    gathered = {r["__chunk"]: r["n"] for r in need.join(F.broadcast(size), "__leaf", "left").groupBy("__chunk").agg(F.sum(F.coalesce("n", F.lit(most + 1))).alias("n")).collect()}  # a row for each chunk
    count: dict[int, int] = {}
    for leaf, rows in zip(boxes.column("__leaf").to_pylist(), boxes.column("n").to_pylist()):
        count[leaf >> levels] = count.get(leaf >> levels, 0) + rows  # no place: chunk -1
    pieces = {c: -(-rows // CHUNK_ROWS) for c, rows in count.items()}
    lists = 3 * (k * (16 + 8 * len(carry)) + 8 * tdim + 8)  # bytes of partial lists of a target that searches two units beside its own
    wide = {c for c, rows in count.items() if (m := gathered.get(c, 0)) > most or m * pieces[c] * item_bytes > rows * lists}
    chunks = F.broadcast(spark.createDataFrame([(c, p, c in wide) for c, p in pieces.items()] or [(-1, 1, False)], "__chunk bigint, __pieces bigint, __wide boolean"))  # a row for each chunk
    number = lambda i: F.col("__chunk") * (1 << 24) + i
    placed = placed.withColumn("__chunk", F.shiftright("__leaf", levels)).join(chunks, "__chunk")
    out = []
    if len(wide) < len(pieces) or not pieces:
        left = placed.filter("not __wide").withColumn("__piece", number(F.pmod(F.xxhash64("__row"), F.col("__pieces"))))
        links = need.join(chunks, "__chunk").filter("not __wide").select("__leaf", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias("__i"), "__chunk").select("__leaf", number(F.col("__i")).alias("__piece"))
        right = _renewed(it.join(links, "__leaf").select("__piece", "__v", "__id", *carry))
        left = left.select("__piece", *tg.columns)
        # A chunk is little data and much work, so its tasks are not joined by their bytes.
        tasks = max(1, min(sum(pieces[c] for c in pieces if c not in wide), 1024))
        out.append(left.repartition(tasks, "__piece").groupBy("__piece").cogroup(right.repartition(tasks, "__piece").groupBy("__piece")).applyInArrow(*_chunk_search(tg, k, tdim, width, carry, kind, fields, finish)))
    if wide:
        far = placed.filter("__wide").select(*tg.columns)
        out.append(_applied(_paired(far, it, k, n, width, carry, kind, leaves), carry, fields, finish, k))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _chunk_search(tg, k, tdim, width, carry, kind, fields, finish):
    """The search of one chunk among its items, and the schema of what it returns."""
    keep = [f for f in tg.schema.fields if f.name != "__t"]
    schema = T.StructType(keep + fields)

    def search(lt: pa.Table, rt: pa.Table) -> pa.Table:
        t = _matrix(lt.column("__t"), tdim) if lt.num_rows else np.empty((0, tdim))
        here = ~np.isnan(t).any(axis=1)
        cols = [rt.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in carry]
        cv = np.stack(cols, axis=1).astype("float64") if cols else np.empty((rt.num_rows, 0))
        idx = _Index(_matrix(rt.column("__v"), width), rt.column("__id").combine_chunks().to_numpy(), cv, kind) if here.any() else None
        found = []
        for place in (True, False):
            rows = np.flatnonzero(here == place)
            order, starts = _tile_order(t[rows] if place else np.zeros((len(rows), 1)), CHUNK_BLOCK)
            for s, e in zip(starts, np.append(starts[1:], len(rows))):
                at = rows[order[s:e]]
                batch = lt.take(pa.array(at))
                dist, item = np.zeros((len(at) if place else 0, k)), np.zeros((len(at) if place else 0, k), dtype=int)
                for r, d, p in idx.search(t[at], k) if place else ():
                    dist[r], item[r] = d, p
                ids, values = (idx.ids[item], idx.carry[item]) if place else (item, np.zeros((0, k, len(carry))))
                found.append(pa.table([batch.column(f.name) for f in keep] + finish(batch, np.full(len(at), place), dist, ids, values), names=schema.names))
        return pa.concat_tables(found) if found else pa.table([lt.column(f.name) for f in keep] + finish(lt, np.zeros(0, bool), np.zeros((0, k)), np.zeros((0, k), int), np.zeros((0, k, len(carry)))), names=schema.names)

    return search, schema


def _first_pass(tg, it, k, n, width, carry, kind, leaves=None) -> tuple[DataFrame, DataFrame]:
    """Items with their ``__unit``, and every target place with what a search of its own unit tells.

    Leaves of items above ``UNIT_ROWS`` rows are split by hash, so units are bounded at any size. Places are cut by the same tree into
    chunks of at most about ``UNIT_ROWS``. An exact search of the first unit of a place's own leaf bounds its k-th
    distance; ``__units`` are the other units that this bound cannot exclude, ``part`` the neighbours found so far.
    """
    spark = tg.sparkSession
    tdim = 2 if kind == "segment" else width
    it, splits, meta = leaves or _item_leaves(it, k, n, width, carry, kind)
    leaf, count = meta.column("__leaf").to_numpy(), meta.column("n").to_numpy()
    parts = -(-count // UNIT_ROWS)
    shared = spark.sparkContext.broadcast((leaf, _matrix(meta.column("lo"), tdim), _matrix(meta.column("hi"), tdim), count, parts))
    size = spark.createDataFrame(pa.table({"__leaf": leaf, "__ns": parts}))
    unit = lambda l, i: l * (1 << 32) + i
    it = it.join(F.broadcast(size), "__leaf").withColumn("__unit", unit(F.col("__leaf"), F.pmod(F.xxhash64("__id", "__v"), F.col("__ns")))).drop("__leaf", "__ns")

    places = tg.select("__t").distinct().filter(~F.exists("__t", lambda v: v.isNull() | F.isnan(v)))
    places = write_and_read(_with_leaf(places, "__t", "point", splits, "__leaf"), "places")
    chunks = places.groupBy("__leaf").agg(F.ceil(F.count("*") / UNIT_ROWS).alias("__nc"))  # at most 2 * MAX_TILES rows
    places = places.join(F.broadcast(chunks), "__leaf").select("__t", "__leaf", unit(F.col("__leaf"), F.pmod(F.xxhash64("__t"), F.col("__nc"))).alias("__chunk"))
    home = places.select("__chunk", unit(F.col("__leaf"), F.lit(0)).alias("__unit")).distinct()
    right = _renewed(it.join(home, "__unit").select("__chunk", "__v", "__id", *carry))
    ntype = _neighbor_type(carry)
    schema = T.StructType([T.StructField("__chunk", T.LongType()), T.StructField("__t", T.ArrayType(T.DoubleType())), T.StructField("part", ntype), T.StructField("__units", T.ArrayType(T.LongType()))])

    def search(lt: pa.Table, rt: pa.Table) -> pa.Table:
        number, lo, hi, rows, pieces = shared.value
        found = list(_nearest_lists(lt, rt, k, tdim, width, carry, kind)) if rt.num_rows else []
        t = np.concatenate([f[0] for f in found]) if found else _matrix(lt.column("__t"), tdim)
        bound = np.concatenate([f[1] for f in found]) if found else np.full(len(t), np.inf)
        short = np.isinf(bound)
        bound[short] = _far_bound(t[short], lo, hi, rows, k)
        own = lt.column("__chunk")[0].as_py() >> 32 if lt.num_rows else -1
        lists = []
        for at in _leaves_for(t, bound, lo, hi):
            first = np.repeat(number[at] << 32, pieces[at])
            which = np.arange(len(first)) - np.repeat(np.cumsum(pieces[at]) - pieces[at], pieces[at])
            ids = first + which
            lists.append(ids[ids != own << 32])
        ends = np.concatenate([[0], np.cumsum([len(u) for u in lists])])
        units = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.empty(0, dtype=int)))
        got = pa.chunked_array([f[2] for f in found]) if found else pa.array([[]] * len(t), _arrow_type(carry))
        return pa.table({"__chunk": pa.array([lt.column("__chunk")[0].as_py()] * len(t) if len(t) else [], pa.int64()), "__t": _points(t), "part": got, "__units": units})

    first = places.select("__chunk", "__t").groupBy("__chunk").cogroup(right.groupBy("__chunk")).applyInArrow(search, schema)
    return it, write_and_read(first, "bounds")


def _unit_files(it: DataFrame, width: int, carry: list[str]) -> tuple[str, set[int]]:
    """The folder into which the items of every unit are written, ordered by id, and the units."""
    folder = scratch_path(it.sparkSession, "units")

    def write(table: pa.Table) -> pa.Table:
        unit = table.column("__unit")[0].as_py()
        ids = table.column("__id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        cols = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64) for c in carry]
        data = np.concatenate([_matrix(table.column("__v"), width)[order].ravel(), *(c[order] for c in cols)])
        blobs.write(f"{folder}/{unit}.bin", ids[order].tobytes() + data.tobytes())
        return pa.table({"unit": pa.array([unit], pa.int64())})

    made = it.select("__unit", "__v", "__id", *carry).groupBy("__unit").applyInArrow(write, "unit bigint")
    return folder, {r["unit"] for r in write_and_read(made, "unit-list").collect()}  # a number for each unit


def _unit(folder: str, unit: int, width: int, carry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, coordinates, carried values) of the items of a unit."""
    data = blobs.read(f"{folder}/{unit}.bin")
    n = len(data) // (8 * (1 + width + carry))
    rest = np.frombuffer(data, np.float64, offset=8 * n)
    return np.frombuffer(data, np.int64, n), rest[: n * width].reshape(n, width), rest[n * width :].reshape(carry, n).T


class _Lists:
    """The nearest items found so far of some targets, ordered by (distance, id, carried values); places without an item are infinitely far."""

    def __init__(self, targets: int, k: int, carry: int):
        self.k, self.d, self.ids, self.carry = k, np.full((targets, k), np.inf), np.full((targets, k), np.iinfo(np.int64).max), np.full((targets, k, carry), np.nan)

    def add(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray, carry: np.ndarray) -> None:
        """More items, ordered by target."""
        if not len(row):
            return
        rows, begin, count = np.unique(row, return_index=True, return_counts=True)
        at, place = np.repeat(np.arange(len(rows)), count), self.k + np.arange(len(row)) - np.repeat(begin, count)
        wide = lambda have, new, fill: np.concatenate([have[rows], np.full((len(rows), count.max(), *have.shape[2:]), fill, have.dtype)], axis=1)
        d_, ids_, carry_ = wide(self.d, d, np.inf), wide(self.ids, ids, np.iinfo(np.int64).max), wide(self.carry, carry, np.nan)
        d_[at, place], ids_[at, place], carry_[at, place] = d, ids, carry
        first = np.lexsort((*(carry_[:, :, j] for j in reversed(range(carry_.shape[2]))), ids_, d_), axis=1)[:, : self.k]
        self.d[rows], self.ids[rows] = np.take_along_axis(d_, first, axis=1), np.take_along_axis(ids_, first, axis=1)
        self.carry[rows] = np.take_along_axis(carry_, first[:, :, None], axis=1)


def _paired(tg, it, k, n, width, carry, kind, leaves=None) -> DataFrame:
    tdim = 2 if kind == "segment" else width
    it, first = _first_pass(tg, it, k, n, width, carry, kind, leaves)
    folder, there = _unit_files(it, width, carry)
    shared = tg.sparkSession.sparkContext.broadcast(there)
    ntype = _neighbor_type(carry)
    schema = T.StructType([T.StructField("__t", T.ArrayType(T.DoubleType())), T.StructField("__nn", ntype)])

    def search(table: pa.Table) -> pa.Table:
        t, lists = _matrix(table.column("__t"), tdim), _Lists(table.num_rows, k, len(carry))
        part, units = table.column("part").combine_chunks(), table.column("__units").combine_chunks()
        rows, flat = np.arange(table.num_rows), part.flatten()
        field = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        lists.add(np.repeat(rows, part.value_lengths().to_numpy()), field("dist"), field("id"), np.column_stack([field(c) for c in carry]) if carry else np.empty((len(flat), 0)))
        wanted = units.flatten().to_numpy()
        order, of = np.argsort(wanted, kind="stable"), np.repeat(rows, units.value_lengths().to_numpy())
        number, begin = np.unique(wanted[order], return_index=True)
        for unit, at in zip(number.tolist(), np.split(of[order], begin[1:])):
            if unit not in shared.value:
                continue
            ids, c, cv = _unit(folder, unit, width, len(carry))
            if kind == "point" and width >= WIDE_AXES:
                bounded = at[np.isfinite(lists.d[at, -1])]
                row, item, d = _Wide(c).within(t[bounded], lists.d[bounded, -1])
                lists.add(bounded[row], d, ids[item], cv[item])
                at = at[np.isinf(lists.d[at, -1])]
            for s in range(0, len(at), BLOCK):
                some = at[s : s + BLOCK]
                pick, d = _nearest(t[some], c, min(k, len(ids)), kind)
                lists.add(np.repeat(some, pick.shape[1]), d.ravel(), ids[pick].ravel(), cv[pick].reshape(pick.size, len(carry)))
        full = ~np.isinf(lists.d) | (lists.ids != np.iinfo(np.int64).max)
        ends = np.concatenate([[0], np.cumsum(full.sum(axis=1))])
        nn = _neighbor_array(lists.d[full][:, None], lists.ids[full][:, None], lists.carry[full][:, None], carry).values
        return pa.table({"__t": _points(t), "__nn": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nn)})

    # A chunk is little data and much work, so its tasks are not joined by their bytes.
    tasks = max(1, min(first.select("__chunk").distinct().count(), 4096))
    found = first.repartition(tasks, "__chunk").groupBy("__chunk").applyInArrow(search, schema)
    empty = F.array().cast(ntype)
    return tg.join(found, "__t", "left").withColumn("__nn", F.coalesce("__nn", empty)).drop("__t")


def _arrow_type(carry: list[str]) -> pa.DataType:
    f = [("dist", pa.float64()), ("id", pa.int64())] + [(c, pa.float64()) for c in carry]
    return pa.list_(pa.struct(f))


def nearest_distance(targets: DataFrame, items: DataFrame, out: str = "dist", **kw) -> DataFrame:
    """Distance to the closest item (with ``self_id``: to the closest other one)."""
    return knn_reduce(targets, items, 1, lambda d, _: [d[:, 0]], [T.StructField(out, T.DoubleType())], **kw)


def nearest_line_distance(points: DataFrame, lines: DataFrame, seg_id: str = "seg_id", out: str = "dist", **kw) -> DataFrame:
    """Smallest point-to-segment distance, exact over all segments."""
    return nearest_distance(points, lines, out=out, item_coords=["x1", "y1", "x2", "y2"], item_id=seg_id, kind="segment", **kw)
