"""Regression forests grown level by level, many forests in one set of jobs.

A *spec* is one forest: its parameters and the fold whose rows it must not see. All specs share one table of packed row
blocks; trees are dealt in chunks, so candidates, folds and trees are just rows of the same job.

Growing has two parts. While a node holds more than ``LOCAL`` rows, its level is grown on all blocks: every task adds
histograms of its rows over fixed quantile bins, sums per node pick the best split. Nodes of at most ``LOCAL`` rows are
grown on their own, with exact splits, all nodes of a level at once; a task takes neighbouring nodes of one tree, of about
``HAUL`` rows. A table of at most ``LOCAL`` rows is dealt to chunks of trees directly.

For larger tables rows are neither copied for every tree nor shuffled by node: blocks lie as files in the shared folder,
ordered by the nodes of one tree's top and with the box of their features, and a task reads the blocks whose boxes meet
its nodes. As trees of a forest cut much alike, those are few; boxes only exclude, so the rows are the same whatever they are.

Where trees are work for all cores, a task adds up the histograms of its trees over all blocks, one slab after another, and
grows the trees of a chunk piece by piece, so neither histograms nor nodes are shuffled; with fewer trees both are dealt.
If the bins of all rows also fit into ``HELD`` bytes, a task reads them once and grows the whole tops of its trees.

Trees are written as files into the shared folder, a chunk each, and read by the tasks that predict: no model passes
through the driver or a broadcast. The driver holds the tops of the trees, one node for ``LOCAL`` rows and tree.

Rows enter a tree by a Poisson count drawn from a hash of their key, tree and seed, so results do not depend on the
partitioning. Counts for ``split`` (least rows to split a node) and ``leaf`` are of different rows in the tree; a row
weight multiplies its count. A node looks at a share of the features, drawn by hash. Defined cases: rows without a
target or with a weight of zero or less train nothing; a spec without rows predicts NULL; ties go to the first feature
and the smaller threshold.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.ordering import exact_quantiles
from loamgrid.operators.schema import unpivot
from loamgrid.session import scratch_path, ship_package, write_and_read
from loamgrid.sources import blobs

#: Most rows of a node that one task grows on its own, and rows times trees it grows at once.
LOCAL, AT_ONCE = 1 << 16, 1 << 18
#: Rows that one task adds up at once, of a written block, and of the nodes that one task grows one after another.
SLAB, SHELF, HAUL = 1 << 20, 1 << 15, 1 << 19
#: Histogram bins of the distributed levels, and trees of a chunk.
BINS, CHUNK = 128, 32
#: Bytes of trees that a predicting worker keeps, and rows that go through a file of trees once it is read.
KEPT, GATHER = 1 << 28, 1 << 18
#: Rows times trees that are walked down at once, and bytes of histograms that one task adds up at once.
STEP, SUMS = 1 << 16, 1 << 26
#: Bytes of binned rows that a task may hold while it grows the tops of its trees.
HELD = 1 << 28
MAX_DEPTH = 60
#: Levels of a tree at which its rows are numbered anew.
RENEW = frozenset(range(3, MAX_DEPTH, 3))

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row enters a tree."""
    h = _mix(_mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed << 32 ^ tree) & (1 << 64) - 1))
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")


def n_features(share, total: int) -> int:
    """How many features a node looks at: a number between 0 and 1, ``sqrt``, or ``auto`` (a third)."""
    if share == "sqrt":
        return max(1, int(math.sqrt(total)))
    return max(1, math.ceil(total / 3)) if share == "auto" else max(1, min(total, int(float(share) * total)))


def drawn(trees: np.ndarray, nodes: np.ndarray, total: int, take: int, seed: int) -> np.ndarray:
    """(node, feature) mask of the features that each node looks at."""
    if take >= total:
        return np.ones((len(nodes), total), bool)
    base = _mix(trees.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nodes.astype(np.uint64) + np.uint64(seed))
    h = _mix(base[:, None] ^ np.arange(1, total + 1, dtype=np.uint64)[None])
    out = np.zeros((len(nodes), total), bool)
    np.put_along_axis(out, np.argsort(h, axis=1, kind="stable")[:, :take], True, axis=1)
    return out


class Trees:
    """Nodes of several trees: feature (-1: leaf), threshold, first child, value, gain; ``roots`` has each tree's root."""

    def __init__(self, feature, threshold, child, value, gain, roots):
        self.feature, self.threshold, self.child, self.value, self.gain, self.roots = feature, threshold, child, value, gain, roots

    def at(self, x: np.ndarray, tree: int | None = None) -> np.ndarray:
        """(row, tree) leaf of every row."""
        roots = self.roots if tree is None else self.roots[tree : tree + 1]
        flat, out = np.ascontiguousarray(x).ravel(), np.empty(len(x) * len(roots), np.int64)
        node, place, begin = np.tile(roots, len(x)), np.arange(len(out)), np.repeat(np.arange(len(x)) * x.shape[1], len(roots))
        while len(node):
            f = self.feature.take(node)
            done = np.flatnonzero(f < 0)
            if len(done):
                out[place.take(done)] = node.take(done)
                left = np.flatnonzero(f >= 0)
                if not len(left):
                    break
                node, place, begin, f = node.take(left), place.take(left), begin.take(left), f.take(left)
            node = self.child.take(node) + (flat.take(begin + f) > self.threshold.take(node))
        return out.reshape(len(x), len(roots))

    def levels(self) -> np.ndarray:
        """The nodes level by level, children in the order of their parents."""
        out, level = [], self.roots
        while len(level):
            out.append(level)
            kids = self.child[level[self.feature[level] >= 0]]
            level = np.stack([kids, kids + 1], axis=1).ravel()
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def dump(self, gains: bool = False) -> bytes:
        """What predicting needs, by ``levels``, so that children need no number: the value of a leaf lies where an inner node has its threshold."""
        order = self.levels()
        feature = self.feature[order]
        number = np.where(feature >= 0, self.threshold[order], self.value[order])
        gain = {"gain": self.gain[order]} if gains else {}
        out = io.BytesIO()
        np.savez(out, feature=feature.astype(np.int8 if not len(feature) or feature.max() < 128 else np.int16), number=number, roots=len(self.roots), **gain)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Trees:
        with np.load(io.BytesIO(data)) as f:
            feature, number, m = f["feature"], f["number"], int(f["roots"])
            child = np.where(feature >= 0, m + 2 * (np.cumsum(feature >= 0) - 1), -1)
            return Trees(feature, number, child, number, f["gain"] if "gain" in f.files else None, np.arange(m))


def _by_digits(key: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 to 2 ** 32 - 1: numbers of 16 bits are sorted by their digits."""
    o = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    high = key >> 16
    return o.take(np.argsort(high.take(o).astype(np.uint16), kind="stable")) if high.any() else o


def _sorted(v: np.ndarray, tree: np.ndarray, m: int) -> np.ndarray:
    """Rows by tree and value, then as they come."""
    o = np.argsort(v)
    in_order = v.take(o)
    new = in_order[1:] != in_order[:-1]
    if not new.all():
        rank = np.empty(len(v), np.int64)
        rank[o] = np.concatenate([[0], np.cumsum(new)])
        o = _by_digits(rank)
    return o if m == 1 else o.take(_by_digits(tree.take(o)))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: np.ndarray, trees: np.ndarray, spec: dict, depth: int = 0) -> Trees:
    """Exact trees over rows (x, y, weight, index of the tree they are in), all nodes of a level at once."""
    total, m = x.shape[1], len(trees)
    take, leaf, split = n_features(spec.get("share", "1.0"), total), spec.get("leaf", 1), max(2, spec.get("split", 2))
    seed, most = spec.get("seed", 42), spec.get("depth") or MAX_DEPTH
    cols, flat = [np.ascontiguousarray(x[:, f]) for f in range(total)], np.ascontiguousarray(x).ravel()
    orders = [_sorted(c, tree, m) for c in cols]  # rows by node and value of each feature
    feature, threshold, child, value, gain = ([] for _ in range(5))
    owner, here = np.arange(m), tree.astype(np.int64)  # owner: tree of each open node; here: node of each row in it
    rows, first, start = np.arange(len(y)), 0, depth
    wr, yr, wyr = w, y, w * y
    both = w.astype(complex)  # weight and deviation of each row, which are added up together
    side = np.full(len(y), 2, np.int8)  # 0: goes left, 1: right, 2: to no open node
    while len(owner):
        k = len(owner)
        n, sw, sy = np.bincount(here, minlength=k), np.bincount(here, wr, k), np.bincount(here, wyr, k)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(sw > 0, sy / sw, np.nan)
        off = yr - mean.take(here)  # deviations from the node's mean keep the sums small
        dev = wr * off
        spread = np.bincount(here, dev * off, k)
        open_ = (n >= split) & (n >= 2 * leaf) & (spread > 1e-12 * np.maximum(1.0, sw * mean * mean)) & (depth < most)
        own = np.flatnonzero(open_)
        size = n[own]
        begin = np.cumsum(size) - size
        if not open_.all():
            at = np.flatnonzero(open_.take(here))
            rows, here, wr, yr, wyr, dev = (a.take(at) for a in (rows, here, wr, yr, wyr, dev))
        if len(own) and (first or len(own) < k):
            # Rows of closed nodes go, the others move to their node; the places are the same for every feature.
            right = own % 2 == 1 if first else np.zeros(len(own), bool)
            side[rows] = here % 2 if first else 0
            lefts = np.where(right, 0, size)
            source = np.where(right, lefts.sum() + np.cumsum(size - lefts) - size, np.cumsum(lefts) - lefts)
            source = np.repeat(source - begin, size) + np.arange(len(rows))
            for f, o in enumerate(orders):
                to = side.take(o)
                to = np.concatenate([np.flatnonzero(to == 0), np.flatnonzero(to == 1)])
                orders[f] = o.take(to.take(source))
        if len(own) and depth - start in RENEW:
            # Rows are numbered anew by node, so that what is read of them for a node lies together.
            by = _by_digits(here)
            old = rows.take(by)
            number = np.empty(len(side), np.int64)
            number[old] = rows = np.arange(len(old))
            orders, cols = [number.take(o) for o in orders], [c.take(old) for c in cols]
            flat, both, side = flat.reshape(-1, total).take(old, axis=0).ravel(), both.take(old), np.full(len(old), 2, np.int8)
            here, wr, yr, wyr, dev = (a.take(by) for a in (here, wr, yr, wyr, dev))
        both.imag[rows] = dev
        best, best_f, best_t = np.zeros(k), np.full(k, -1), np.zeros(k)
        looks = drawn(trees[owner], first + np.arange(k), total, take, seed)[own] if take < total else None
        block = np.repeat(np.arange(len(own)), size)
        for f in range(total if len(own) else 0):
            r, own_, size_, begin_, block_ = orders[f], own, size, begin, block
            if looks is not None:
                use = looks[:, f]
                own_, size_ = own[use], size[use]
                if not len(own_):
                    continue
                r, begin_, block_ = r.take(np.flatnonzero(use.take(block))), np.cumsum(size_) - size_, np.repeat(np.arange(len(own_)), size_)
            v, each = cols[f].take(r), both.take(r)
            ok = np.empty(len(r), bool)
            np.not_equal(v[1:], v[:-1], out=ok[:-1])
            ok[begin_ + size_ - 1] = False
            if leaf > 1:
                done = np.arange(1, len(r) + 1) - begin_.take(block_)
                ok &= (done >= leaf) & (size_.take(block_) - done >= leaf)
            cand = np.flatnonzero(ok)
            if not len(cand):
                continue
            left = np.cumsum(each)
            before, weight = left[begin_] - each[begin_], sw[own_]
            if 3 * len(cand) < len(r):
                of = block_.take(cand)
                left = left.take(cand) - before.take(of)
                weight = weight.take(of)
                head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            else:  # most places are candidates: all are tried, which needs no copies, and the others are put to 0
                cand, of, head = None, block_, begin_
                left -= np.repeat(before, size_)
                weight = np.repeat(weight, size_)
            lw, ly = left.real, left.imag
            # The deviations of both sides add up to zero.
            with np.errstate(divide="ignore", invalid="ignore"):
                g = ly * ly * (1 / lw + 1 / (weight - lw))
            if cand is None:
                g[np.flatnonzero(~ok)] = 0.0
            top = np.maximum.reduceat(g, head)
            hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(head, len(g)))))
            which = of.take(hit)
            one = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            pos, tag = hit[one], own_[which[one]]
            pos = pos if cand is None else cand[pos]
            better = top > best[tag] * (1 + 1e-12)
            pos, tag = pos[better], tag[better]
            lo, hi = v[pos], v[pos + 1]
            mid = lo + (hi - lo) / 2
            best[tag], best_f[tag], best_t[tag] = top[better], f, np.where(mid < hi, mid, lo)
        cut = best_f >= 0
        place = np.cumsum(cut) - 1
        feature.append(best_f)
        threshold.append(best_t)
        child.append(np.where(cut, first + k + 2 * place, -1))
        value.append(mean)
        gain.append(best)
        owner, first, depth = np.repeat(owner[cut], 2), first + k, depth + 1
        if not len(owner):
            break
        side[rows] = 2
        if not cut[own].all():
            at = np.flatnonzero(cut.take(here))
            rows, here, wr, yr, wyr = (a.take(at) for a in (rows, here, wr, yr, wyr))
        here = 2 * place.take(here) + (flat.take(rows * total + best_f.take(here)) > best_t.take(here))
    return Trees(*(np.concatenate(a) for a in (feature, threshold, child, value, gain)), np.arange(m))


# ---------------------------------------------------------------- training table


def pack(df: DataFrame, key: Column, target: Column, features: list[Column], weight: Column | None = None, test: Column | None = None) -> DataFrame:
    """Row blocks: n, keys, x, y, w and ``test`` (bit ``f`` set: the row is a test row of fold ``f``), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            x = np.column_stack(cols[4:]).astype(np.float64) if len(cols) > 4 else np.zeros((b.num_rows, 0))
            packed = [np.asarray(cols[0], np.int64), x, np.asarray(cols[1], np.float64), np.asarray(cols[2], np.float64), np.asarray(cols[3], np.int64)]
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], **{c: [v.tobytes()] for c, v in zip(("keys", "x", "y", "w", "test"), packed)}})

    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(key.cast("long").alias("k"), target.cast("double").alias("y"), w.alias("w"), (F.lit(0) if test is None else test).cast("long").alias("test"), *(c.cast("double").alias(f"f{i}") for i, c in enumerate(features)))
    rows = rows.where("k is not null and y is not null and w > 0").dropna()
    return write_and_read(rows.mapInArrow(run, "n bigint, keys binary, x binary, y binary, w binary, test binary"), "forest-rows")


class _Block:
    def __init__(self, keys: bytes, x: bytes, y: bytes, w: bytes, test: bytes):
        self.keys, self.y, self.w, self.test = (np.frombuffer(d, t) for d, t in ((keys, np.int64), (y, np.float64), (w, np.float64), (test, np.int64)))
        self.x = np.frombuffer(x, np.float64).reshape(len(self.y), -1) if len(self.y) else np.zeros((0, 0))

    def train(self, spec: dict, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows in a tree, their weights there)."""
        count = in_bag(self.keys, tree, spec.get("seed", 42))
        if spec.get("fold") is not None:
            count = np.where(self.test >> spec["fold"] & 1, 0, count)
        rows = np.flatnonzero(count)
        return rows, count[rows] * self.w[rows]


def _chunks(specs: list[dict], per: int) -> list[tuple[int, int, int]]:
    """(spec, first tree, number of trees)."""
    return [(s, t, min(per, p["trees"] - t)) for s, p in enumerate(specs) for t in range(0, p["trees"], per)]


class Forests:
    """Fitted forests: the files of their trees, and importances per spec."""

    def __init__(self, spark, folder: str, specs: list[dict], parts: list[tuple[int, str]], importances: DataFrame, features: int):
        self.spark, self.folder, self.specs, self.parts, self.gains, self.n_features = spark, folder, specs, parts, importances, features

    def importances(self) -> DataFrame:
        """spec, feature (its place) and importance: each tree's gains add up to one, trees are averaged."""
        return self.gains

    def predict(self, df: DataFrame, features: list[Column], spec: int = 0, out: str = "trend") -> DataFrame:
        """``df`` with the mean of the trees of one forest."""
        score = _scorer([p for s, p in self.parts if s == spec], self.folder)

        @F.pandas_udf("double")
        def trend(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for some in _gathered(np.column_stack([s.to_numpy(np.float64) for s in c]) for c in cols):
                got = score(np.concatenate(some))
                yield from (pd.Series(v) for v in np.split(got, np.cumsum([len(x) for x in some[:-1]])))

        return df.withColumn(out, trend(*(c.cast("double") for c in features)))

    def scores(self, df: DataFrame, key: Column, features: list[Column], test: Column, held: bool = False) -> DataFrame:
        """key, spec, trend and ``held`` (whether the row is a test row of the spec's fold) of every row and spec, or of
        the test rows only."""
        parts, folder, specs = self.parts, self.folder, self.specs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = [_scorer([p for s, p in parts if s == i], folder) for i in range(len(specs))]
            for some in _gathered(b for b in batches if b.num_rows):
                keys, mask, spec, *cols = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in some]) for c in range(some[0].num_columns))
                x = np.column_stack(cols).astype(np.float64)
                for i in np.unique(spec).tolist():
                    rows = np.flatnonzero(spec == i)
                    is_test = (mask[rows] >> specs[i]["fold"] & 1).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(np.full(len(rows), i, np.int32)), pa.array(scores[i](x[rows]), from_pandas=True), pa.array(is_test)], ["key", "spec", "trend", "held"])

        mine = lambda i, p: F.when(test.cast("long").bitwiseAND(F.lit(1 << p["fold"]).cast("long")) != 0, F.lit(i)) if held else F.lit(i)
        wanted = F.array_compact(F.array(*[mine(i, p) for i, p in enumerate(specs)]))
        src = df.select(key.cast("long").alias("key"), test.cast("long").alias("test"), F.explode(wanted).alias("spec"), *(c.cast("double").alias(f"f{i}") for i, c in enumerate(features)))
        # Little data and much work: each task has rows of one spec, so it reads that forest only.
        deal = max(1, -(-2 * self.spark.sparkContext.defaultParallelism // len(specs)))
        src = src.where("key is not null and test is not null").repartitionById(deal * len(specs), F.col("spec") * deal + F.pmod(F.xxhash64("key"), F.lit(deal)).cast("int"))
        return src.mapInArrow(run, "key bigint, spec int, trend double, held boolean")


_kept: OrderedDict[str, Trees] = OrderedDict()


def _load(path: str) -> Trees:
    if path in _kept:
        _kept.move_to_end(path)
    else:
        _kept[path] = Trees.load(blobs.read(path))
        while len(_kept) > 1 and sum(17 * len(t.feature) for t in _kept.values()) > KEPT:
            _kept.popitem(last=False)
    return _kept[path]


def _gathered(batches: Iterator) -> Iterator[list]:
    """Batches (arrays or record batches) in lists of ``GATHER`` rows, so that trees beyond ``KEPT`` are not read anew for every batch."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += len(b)
        if n >= GATHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def _scorer(files: list[str], folder: str):
    def score(x: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(x)), 0
        for name in files:
            trees = _load(f"{folder}/{name}")
            step = max(1, STEP // max(1, len(trees.roots)))
            for lo in range(0, len(x), step):
                total[lo : lo + step] += trees.value[trees.at(x[lo : lo + step])].sum(axis=1)
            n += len(trees.roots)
        return total / n if n else np.full(len(x), np.nan)

    return score


# ---------------------------------------------------------------- growing


def fit_forests(rows: DataFrame, n_features_: int, specs: list[dict], local: int | None = None) -> Forests:
    """Forests over ``pack``-ed rows. A spec has trees, depth (0: unlimited), leaf, split, share, seed and fold."""
    spark, local = rows.sparkSession, local or LOCAL
    ship_package(spark)
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    folder = scratch_path(spark, "forest")
    chunks = _chunks(specs, max(1, min(CHUNK, AT_ONCE // max(1, min(n, local)))))
    if n <= local:
        dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))).repartition(min(len(chunks), 4096), "chunk")

        def build(table: pa.Table) -> pa.Table:
            c = table.column("chunk")[0].as_py()
            s, t0, k = chunks[c]
            blocks = [_Block(*(table.column(v)[i].as_py() for v in ("keys", "x", "y", "w", "test"))) for i in range(table.num_rows)]
            whole = _joined(blocks)
            order = np.argsort(whole.keys, kind="stable")
            whole.keys, whole.x, whole.y, whole.w, whole.test = (a[order] for a in (whole.keys, whole.x, whole.y, whole.w, whole.test))
            got = [whole.train(specs[s], t0 + t) for t in range(k)]
            at, tree = np.concatenate([r for r, _ in got]), np.repeat(np.arange(k), [len(r) for r, _ in got])
            trees = grow(whole.x[at], whole.y[at], np.concatenate([w for _, w in got]), tree, np.arange(t0, t0 + k), specs[s])
            return _saved(folder, c, s, trees, n_features_)

        made = dealt.groupBy("chunk").applyInArrow(build, _MADE)
    else:
        shelf = _shelved(rows, n_features_, f"{folder}/rows")
        tops = _grow_tops(rows, shelf, n_features_, specs, chunks, local)
        first = tops[0][0].trees()
        if len(first.feature) > 1:
            shelf = _shelved(rows, n_features_, f"{folder}/nodes", first)
        made = _grow_rest(spark, shelf, folder, specs, chunks, tops, n_features_)
    made = write_and_read(made, "forest-parts")
    parts = [(r["spec"], r["file"]) for r in made.select("spec", "file").distinct().orderBy("spec", "file").collect()]  # a name for each chunk
    per = made.select("spec", F.posexplode("gains").alias("feature", "gain"), "trees").groupBy("spec", "feature").agg((F.sum("gain") / F.sum("trees")).alias("importance"))
    return Forests(spark, folder, specs, parts, per, n_features_)


_MADE = "spec int, file string, trees bigint, gains array<double>"


def _joined(blocks: list[_Block]) -> _Block:
    out = blocks[0]
    if len(blocks) > 1:
        out.keys, out.x, out.y, out.w, out.test = (np.concatenate([getattr(b, a) for b in blocks]) for a in ("keys", "x", "y", "w", "test"))
    return out


def _tree_gains(trees: Trees, features: int) -> np.ndarray:
    """Gains of each feature, those of a tree adding up to one, summed over trees."""
    tree, split = np.full(len(trees.feature), -1), np.flatnonzero(trees.feature >= 0)
    tree[trees.roots] = np.arange(len(trees.roots))
    for i in split.tolist() if len(split) < 64 else ():
        tree[trees.child[i] : trees.child[i] + 2] = tree[i]
    if len(split) >= 64:
        level = trees.roots
        while len(level):
            level = level[trees.feature[level] >= 0]
            kids = np.concatenate([trees.child[level], trees.child[level] + 1])
            tree[kids] = np.tile(tree[level], 2)
            level = kids
    g = np.zeros((len(trees.roots), features))
    np.add.at(g, (tree[split], trees.feature[split]), trees.gain[split])
    total = g.sum(axis=1, keepdims=True)
    return (g / np.where(total > 0, total, 1.0)).sum(axis=0)


def _saved(folder: str, chunk: int, spec: int, trees: Trees, features: int) -> pa.Table:
    name = f"{chunk:07d}.npz"
    blobs.write(f"{folder}/{name}", trees.dump())
    kinds = pa.schema([("spec", pa.int32()), ("file", pa.string()), ("trees", pa.int64()), ("gains", pa.list_(pa.float64()))])
    return pa.table({"spec": [spec], "file": [name], "trees": [len(trees.roots)], "gains": [_tree_gains(trees, features).tolist()]}, schema=kinds)


class _Top:
    """The upper part of one tree, grown on all blocks; open leaves have more than ``local`` rows. ``size``: rows of each node."""

    def __init__(self):
        self.feature, self.threshold, self.child, self.gain, self.depth, self.open, self.size = [-1], [0.0], [-1], [0.0], [0], [True], [0.0]

    def trees(self) -> Trees:
        return Trees(np.array(self.feature), np.array(self.threshold), np.array(self.child), np.zeros(len(self.feature)), np.array(self.gain), np.zeros(1, np.int64))

    def split(self, v: int, found: dict, local: int, most: int) -> None:
        """Closes node ``v`` of an open level: its children follow where it has more than ``local`` rows and a split."""
        self.open[v], self.size[v] = False, found["n"]
        if found["n"] > local and found["feature"] >= 0 and self.depth[v] < most:
            self.feature[v], self.threshold[v], self.child[v], self.gain[v] = found["feature"], found["threshold"], len(self.feature), found["gain"]
            for size in (found["n_left"], found["n"] - found["n_left"]):
                self.feature.append(-1), self.threshold.append(0.0), self.child.append(-1), self.gain.append(0.0)
                self.depth.append(self.depth[v] + 1), self.size.append(size)
                self.open.append(size > local and self.depth[v] + 1 < most)

    def leaves(self, features: int) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """(leaf, rows, least and largest features) of leaves with rows, neighbours one after another."""
        stack = [(0, np.full(features, -np.inf), np.full(features, np.inf))]
        while stack:
            v, lo, hi = stack.pop()
            if self.feature[v] < 0:
                if self.size[v]:
                    yield v, self.size[v], lo, hi
                continue
            left, right = hi.copy(), lo.copy()
            left[self.feature[v]] = right[self.feature[v]] = self.threshold[v]
            stack += [(self.child[v] + 1, right, hi), (self.child[v], lo, left)]


def _shelved(rows: DataFrame, features: int, folder: str, top: Trees | None = None) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Blocks written as files: (file, rows, least and largest features) of each; with ``top`` the rows of a block lie in one of its leaves."""
    names = ("keys", "x", "y", "w", "test")

    def written(leaf: int, blocks: list[_Block]) -> pa.RecordBatch:
        b = _joined(blocks)
        data = b"".join(np.ascontiguousarray(getattr(b, c)).tobytes() for c in names)
        file = f"{folder}/{leaf:07d}-{hashlib.sha256(data).hexdigest()}.bin"  # equal blocks may share a file
        blobs.write(file, data)
        return pa.RecordBatch.from_pydict({"file": [file], "n": pa.array([len(b.y)], pa.int64()), **{c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in (("lo", b.x.min(axis=0)), ("hi", b.x.max(axis=0)))}})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(*(batch.column(c)[i].as_py() for c in names))
                at = top.at(b.x)[:, 0]
                order = np.argsort(at, kind="stable")
                leaf, begin = np.unique(at[order], return_index=True)
                parts = np.split(order, begin[1:])
                yield pa.RecordBatch.from_pydict({"leaf": leaf, **{c: [getattr(b, c)[p].tobytes() for p in parts] for c in names}})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, now, n = [], -1, 0
        for batch in batches:
            for i in range(batch.num_rows):
                leaf, b = batch.column("leaf")[i].as_py(), _Block(*(batch.column(c)[i].as_py() for c in names))
                if some and (leaf != now or n >= SHELF):
                    yield written(now, some)
                    some, n = [], 0
                some.append(b)
                now, n = leaf, n + len(b.y)
        if n:
            yield written(now, some)

    if top is None:
        src = rows.where("n > 0").withColumn("leaf", F.lit(0).cast("long"))
    else:
        tasks = max(1, min(int((top.feature < 0).sum()), 4 * rows.sparkSession.sparkContext.defaultParallelism))
        src = rows.mapInArrow(cut, "leaf bigint, keys binary, x binary, y binary, w binary, test binary").repartition(tasks, "leaf").sortWithinPartitions("leaf")
    made = write_and_read(src.select("leaf", *names).mapInArrow(write, "file string, n bigint, lo array<double>, hi array<double>"), "forest-shelf")
    return [(r["file"], r["n"], np.array(r["lo"]), np.array(r["hi"])) for r in made.orderBy("file").collect()]  # a row for each block


def _taken(file: str, n: int, features: int) -> _Block:
    data = memoryview(blobs.read(file))
    ends = np.cumsum([8 * n, 8 * n * features, 8 * n, 8 * n, 8 * n]).tolist()
    return _Block(*(data[a:b] for a, b in zip([0, *ends], ends)))


def _numbered(spark, n: int) -> DataFrame:
    """Numbers of ``n`` pieces of work as ``id``, about even over tasks."""
    return spark.range(0, n, 1, max(1, min(n, 64 * spark.sparkContext.defaultParallelism, 4096)))


def _best(spec: dict, tree: int, v: int, h: np.ndarray, edges: list[np.ndarray]) -> dict:
    """The best split of a node from its histogram (feature, [rows, weight, weighted target], bin)."""
    features = len(edges)
    count, sw, sy = h[0].sum(axis=1)
    leaf = spec.get("leaf", 1)
    looks = drawn(np.array([tree]), np.array([v]), features, n_features(spec.get("share", "1.0"), features), spec.get("seed", 42))[0]
    lc, lw, ly = (np.cumsum(h[:, j], axis=1) for j in range(3))
    mean = sy / sw if sw > 0 else 0.0
    dev = ly - lw * mean
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where((lc >= leaf) & (count - lc >= leaf) & (lw > 0) & (sw - lw > 0), dev * dev / lw + dev * dev / (sw - lw), 0.0)
    g[~looks] = 0.0
    for f, e in enumerate(edges):
        g[f, len(e) :] = 0.0
    f, b = np.unravel_index(int(np.argmax(g)), g.shape)
    ok = bool(g[f, b] > 0 and count >= max(2, spec.get("split", 2)))
    return {"feature": int(f) if ok else -1, "threshold": float(edges[f][b]) if ok else 0.0, "gain": float(g[f, b]), "n_left": float(lc[f, b]), "n": float(count)}


class _Held:
    """A slab whose rows are held while many trees are grown: their bins in place of their features."""

    def __init__(self, block: _Block, edges: list[np.ndarray]):
        self.bins = np.stack([np.searchsorted(e, block.x[:, f], "left").astype(np.uint8) for f, e in enumerate(edges)])
        # Copies, so that the file's bytes go; columns of one value take no room.
        self.rows = _Block(b"", b"", b"", b"", b"")
        for c in ("keys", "y", "w", "test"):
            v = getattr(block, c)
            setattr(self.rows, c, np.broadcast_to(v[0].copy(), v.shape) if (v == v[0]).all() else np.array(v))


def _whole_top(slabs: list[_Held], spec: dict, tree: int, edges: list[np.ndarray], local: int) -> _Top:
    """The top of one tree from all rows, level by level; a row goes right where its bin is above the split's."""
    top, most = _Top(), spec.get("depth") or MAX_DEPTH
    state = []  # of each slab: rows in the tree, their weights and nodes
    for slab in slabs:
        r, w = slab.rows.train(spec, tree)
        state.append((r.astype(np.int32), w, np.zeros(len(r), np.int32)))
    while any(top.open):
        open_ = np.flatnonzero(top.open)
        place = np.full(len(top.feature), -1)
        place[open_] = np.arange(len(open_))
        sums = np.zeros((len(open_), len(edges), 3, BINS))
        for i, slab in enumerate(slabs):
            r, w, node = state[i]
            slot = place.take(node)
            if len(slot) and slot.min() < 0:
                ok = np.flatnonzero(slot >= 0)
                r, w, node, slot = (a.take(ok) for a in (r, w, node, slot))
                state[i] = r, w, node
            slot *= BINS
            wy = w * slab.rows.y[r]
            for f in range(len(edges)):
                cell = slot + slab.bins[f].take(r)
                for j, v in enumerate((None, w, wy)):
                    sums[:, f, j] += np.bincount(cell, v, len(open_) * BINS).reshape(-1, BINS)
        for j, v in enumerate(open_.tolist()):
            if sums[j, 0, 0].any():
                top.split(v, _best(spec, tree, v, sums[j], edges), local, most)
            else:  # no row reached it
                top.open[v] = False
        feature, child = np.array(top.feature), np.array(top.child)
        cut = np.array([np.searchsorted(edges[f], t) if f >= 0 else 0 for f, t in zip(top.feature, top.threshold)])
        for i, slab in enumerate(slabs):
            r, w, node = state[i]
            f = feature.take(node)
            right = slab.bins.ravel().take(np.maximum(f, 0) * slab.bins.shape[1] + r) > cut.take(node)
            state[i] = r, w, np.where(f >= 0, child.take(node) + right, node).astype(np.int32)
    return top


def _grow_whole_tops(spark, slabs: list[list[tuple[str, int]]], edges: list[np.ndarray], specs: list[dict], chunks: list[tuple[int, int, int]], local: int) -> list[list[_Top]]:
    """The tops of all trees, each grown by one task."""
    tasks = min(len(chunks), 4 * spark.sparkContext.defaultParallelism)
    kinds = pa.schema([("chunk", pa.int32()), ("tree", pa.int32()), *((c, pa.list_(t)) for c, t in _TOP)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            held = held or [_Held(_joined([_taken(file, n, len(edges)) for file, n in slab]), edges) for slab in slabs]
            for c in range(i, len(chunks), tasks):
                s, t0, k = chunks[c]
                for t in range(k):
                    top = _whole_top(held, specs[s], t0 + t, edges, local)
                    yield pa.RecordBatch.from_pylist([{"chunk": c, "tree": t, **{n: getattr(top, n) for n, _ in _TOP}}], schema=kinds)

    tops = [[_Top() for _ in range(k)] for _, _, k in chunks]
    names = ", ".join(f"{c} array<{'int' if t == pa.int32() else 'double'}>" for c, t in _TOP)
    for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, f"chunk int, tree int, {names}").collect():  # a node for each ``local`` rows
        top = tops[r["chunk"]][r["tree"]]
        for c, _ in _TOP:
            setattr(top, c, list(r[c]))
        top.open = [False] * len(top.feature)
    return tops


_TOP = [("feature", pa.int32()), ("threshold", pa.float64()), ("child", pa.int32()), ("gain", pa.float64()), ("depth", pa.int32()), ("size", pa.float64())]


def _grow_tops(rows: DataFrame, shelf: list[tuple], features: int, specs: list[dict], chunks: list[tuple[int, int, int]], local: int) -> list[list[_Top]]:
    """Levels whose nodes are too large for a task: histograms are summed over tasks, then each node takes its best bin."""
    spark = rows.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(0)[i].as_py(), np.float64).reshape(-1, features)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, f]) for f in range(features)], [f"f{f}" for f in range(features)])

    names = [f"f{f}" for f in range(features)]
    values = rows.select("x").mapInArrow(spread, ", ".join(f"{f} double" for f in names))
    found = {r["feature"]: r["q"] for r in exact_quantiles(unpivot(values, names), "value", [i / BINS for i in range(1, BINS)], ["feature"], few=True).collect()}  # BINS numbers for each feature
    edges = [np.unique(np.array(found.get(f, []), np.float64)) for f in names]
    slabs, room = [], 0
    for file, n, _, _ in shelf:
        if room < n:
            slabs.append([])
            room = SLAB
        slabs[-1].append((file, n))
        room -= n
    if features and len(chunks) >= 4 * spark.sparkContext.defaultParallelism and sum(n for _, n, _, _ in shelf) * (features + 24) <= HELD:
        return _grow_whole_tops(spark, slabs, edges, specs, chunks, local)
    tops = [[_Top() for _ in range(k)] for _, _, k in chunks]
    while any(any(t.open) for c in tops for t in c):
        shared = spark.sparkContext.broadcast([[(t.trees(), np.flatnonzero(t.open)) for t in c] for c in tops])  # a node for each ``local`` rows
        live = [i for i, c in enumerate(tops) if any(any(t.open) for t in c)]
        # Trees are dealt first: where they are work for all cores, a task adds up all blocks, slab by slab, and no histogram is sent.
        busy = 4 * spark.sparkContext.defaultParallelism
        nodes = sum(sum(t.open) for i in live for t in tops[i])
        groups = min(len(live), max(busy, -(-nodes * features * 24 * BINS // SUMS)))
        shares = min(len(slabs), -(-busy // groups))
        work = [(slabs[i::shares], live[g::groups]) for i in range(shares) for g in range(groups)]
        whole = shares == 1

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
            for i in (i for b in batches for i in b.column(0).to_pylist()):
                mine, sums = work[i][1], {}
                for slab in work[i][0]:
                    block = _joined([_taken(file, n, features) for file, n in slab])
                    bins = [np.searchsorted(e, block.x[:, f], "left").astype(np.uint8) for f, e in enumerate(edges)]
                    for c in mine:
                        s, t0, k = chunks[c]
                        for t in range(k):
                            top, open_ = shared.value[c][t]
                            if not len(open_):
                                continue
                            r, w = block.train(specs[s], t0 + t)
                            at = top.at(block.x[r])[:, 0]
                            slot = np.searchsorted(open_, at)
                            ok = (slot < len(open_)) & (open_[np.minimum(slot, len(open_) - 1)] == at)
                            r, w, slot = r[ok], w[ok], slot[ok] * BINS
                            wy = w * block.y[r]
                            h = sums.setdefault((c, t), np.zeros((len(open_), features, 3, BINS)))
                            for f in range(features):
                                cell = slot + bins[f][r]
                                for j, v in enumerate((None, w, wy)):
                                    h[:, f, j] += np.bincount(cell, v, len(open_) * BINS).reshape(-1, BINS)
                for (c, t), h in sums.items():
                    for j in np.flatnonzero(h[:, 0, 0].any(axis=1)).tolist() if features else ():
                        yield c, t, int(shared.value[c][t][1][j]), h[j]

        def best(c: int, t: int, v: int, h: np.ndarray) -> dict:
            s, t0, _ = chunks[c]
            return {"chunk": c, "tree": t, "node": v, **_best(specs[s], t0 + t, v, h, edges)}

        def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [best(*found) for found in histograms(batches)]
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=kinds)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, t, v, h in histograms(batches):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([t], pa.int32()), pa.array([v], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["chunk", "tree", "node", "h"])

        def together(table: pa.Table) -> pa.Table:
            h = sum(np.frombuffer(b.as_py(), np.float64).reshape(features, 3, BINS) for b in table.column("h"))
            return pa.Table.from_pylist([best(*(table.column(i)[0].as_py() for i in ("chunk", "tree", "node")), h)], schema=kinds)

        kinds = pa.schema([("chunk", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("n_left", pa.float64()), ("n", pa.float64())])
        names_ = "chunk int, tree int, node bigint, feature int, threshold double, gain double, n_left double, n double"
        pieces = _numbered(spark, len(work))
        if whole:
            got = pieces.mapInArrow(decided, names_).collect()
        else:
            got = pieces.mapInArrow(sent, "chunk int, tree int, node bigint, h binary").groupBy("chunk", "tree", "node").applyInArrow(together, names_).collect()
        seen = set()
        for r in got:
            seen.add((r["chunk"], r["tree"], r["node"]))
            tops[r["chunk"]][r["tree"]].split(r["node"], r.asDict(), local, specs[chunks[r["chunk"]][0]].get("depth") or MAX_DEPTH)
        for c in live:  # nodes that no row reached
            for t, top in enumerate(tops[c]):
                for v in np.flatnonzero(top.open).tolist():
                    if (c, t, v) not in seen and v < len(shared.value[c][t][0].feature):
                        top.open[v] = False
        shared.unpersist()
    return tops


def _hauls(tops: list[list[_Top]], shelf: list[tuple], features: int) -> list[tuple[int, int, list[int], list[tuple[str, int]]]]:
    """(chunk, tree, nodes, blocks) of every piece of work: neighbouring nodes of a tree, and the blocks that can hold their rows."""
    low, high = np.array([s[2] for s in shelf]), np.array([s[3] for s in shelf])
    out = []
    for c, trees in enumerate(tops):
        for t, top in enumerate(trees):
            nodes, meets, rows = [], np.zeros(len(shelf), bool), 0
            for v, n, lo, hi in [*top.leaves(features), (-1, math.inf, None, None)]:
                if nodes and rows + n > HAUL:
                    out.append((c, t, nodes, [shelf[i][:2] for i in np.flatnonzero(meets).tolist()]))
                    nodes, meets, rows = [], np.zeros(len(shelf), bool), 0
                if v >= 0:
                    nodes.append(v)
                    meets |= ((low <= hi) & (high >= lo)).all(axis=1)
                    rows += n
    return out


def _grow_rest(spark, shelf: list[tuple], folder: str, specs: list[dict], chunks: list[tuple[int, int, int]], tops: list[list[_Top]], features: int) -> DataFrame:
    """Subtrees below the tops, each from its rows in the blocks, then each chunk's trees put together."""
    shared = spark.sparkContext.broadcast([[(t.trees(), np.array(t.depth)) for t in c] for c in tops])
    hauls = _hauls(tops, shelf, features)
    # Where chunks are work for all cores, a task grows all of its chunk, haul by haul, and no node is sent.
    whole = len(chunks) >= 4 * spark.sparkContext.defaultParallelism
    pieces: dict[int, list] = {}
    for i, haul in enumerate(hauls):
        pieces.setdefault(haul[0] if whole else i, []).append(haul)
    pieces = list(pieces.values())
    work = spark.sparkContext.broadcast(pieces)  # a node for each ``local`` rows

    def subtrees(c: int, t: int, nodes: list[int], files: list[tuple[str, int]]) -> Iterator[tuple[int, int, Trees]]:
        s, t0, _ = chunks[c]
        top, depth = shared.value[c][t]
        mine, got = np.isin(np.arange(len(top.feature)), nodes), []
        for file, n in files:
            block = _taken(file, n, features)
            r, w = block.train(specs[s], t0 + t)
            at = top.at(block.x[r])[:, 0]
            ok = mine[at]
            r = r[ok]
            got.append((at[ok], block.keys[r], block.x[r], block.y[r], w[ok]))
        at, keys, x, y, w = (np.concatenate(a) for a in zip(*got))
        order = np.lexsort((keys, at))
        leaf, begin = np.unique(at[order], return_index=True)
        for v, o in zip(leaf.tolist(), np.split(order, begin[1:])):
            # Splits of a subtree are drawn under a number of their own.
            yield t, v, grow(x[o], y[o], w[o], np.zeros(len(o), np.int64), np.array([(t0 + t) * 1_000_003 + v]), specs[s], int(depth[v]))

    def put_together(c: int, below: dict[tuple[int, int], Trees]) -> pa.Table:
        s, _, k = chunks[c]
        parts, roots, size = [], [], 0
        for t in range(k):
            top = shared.value[c][t][0]
            roots.append(size)
            arrays = [a.copy() for a in (top.feature, top.threshold, np.where(top.child >= 0, top.child + size, -1), np.full(len(top.feature), np.nan), top.gain)]
            size += len(top.feature)
            own = [arrays]
            for (tt, v), sub in below.items():
                if tt != t:
                    continue
                # The subtree's root takes the top's leaf, its other nodes follow.
                move = lambda ch, at=size: np.where(ch >= 0, ch - 1 + at, -1)
                kid = move(sub.child)
                for a, b in zip(arrays, (sub.feature, sub.threshold, kid, sub.value, sub.gain)):
                    a[v] = b[0]
                own.append([sub.feature[1:], sub.threshold[1:], kid[1:], sub.value[1:], sub.gain[1:]])
                size += len(sub.feature) - 1
            parts.append([np.concatenate([o[j] for o in own]) for j in range(5)])
        trees = Trees(*(np.concatenate([p[j] for p in parts]) for j in range(5)), np.array(roots))
        return _saved(folder, c, s, trees, features)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            below = {(t, v): trees for haul in work.value[i] for t, v, trees in subtrees(*haul)}
            yield from put_together(work.value[i][0][0], below).to_batches()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            for haul in work.value[i]:
                for t, v, trees in subtrees(*haul):
                    yield pa.RecordBatch.from_arrays([pa.array([haul[0]], pa.int32()), pa.array([t], pa.int32()), pa.array([v], pa.int64()), pa.array([trees.dump(True)], pa.binary())], ["chunk", "tree", "node", "nodes"])

    def together(table: pa.Table) -> pa.Table:
        return put_together(table.column("chunk")[0].as_py(), {(t, v): Trees.load(d.as_py()) for t, v, d in zip(table.column("tree").to_pylist(), table.column("node").to_pylist(), table.column("nodes"))})

    if whole:
        return _numbered(spark, len(pieces)).mapInArrow(kept, _MADE)
    parts = _numbered(spark, len(pieces)).mapInArrow(sent, "chunk int, tree int, node bigint, nodes binary")
    return parts.repartition(max(1, min(len(chunks), 4096)), "chunk").groupBy("chunk").applyInArrow(together, _MADE)
