"""Near duplicates by bottom-k sketches of one hash function.

A text's set is its distinct five-word shingles. The ``k`` smallest hashes of a set are its sketch.

1. Equal sets become one class, so copies cost one row each and never meet in pairs.
2. Sketch values that occur in one class only are dropped. The rest are inverted lists. A class keeps its rarest
   values: texts that reach the similarity share so many sketch values that two of them must meet among these (exact
   for sets up to ``k``, beyond that with a miss chance below 1e-5 at the very threshold). Values of passages that
   many texts share come last and hardly ever matter.
3. Everybody in a list is paired with a few members of it only; the union sketch estimates the similarity and drops
   what is far below; the exact similarity of whole sets confirms each class's best pair. Linked classes are contracted.
4. Lists that then still hold different components are put together by their largest component and worked off in
   pairs of blocks: inside a task, overlaps of sketches and then of whole sets are counted for members of different
   components, and only links come out. So a group of thousands of near copies never becomes all its pairs, nothing
   is capped, and no link between different texts is lost.

Defined cases: null or wordless texts have an empty set and link with nothing; fewer than five words form one shingle;
repeated rows are copies; rows are numbered and written first, so texts are found by row whatever their ids; rows that share a document id stay separate rows of the result; a null document id is
never a component's smallest unless it has no other; an empty table gives an empty result. ``keep_one_each`` goes by
rows: one row of each component stays, so different texts that share an id, or have none, all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.arrays import Hasher, column_bytes, mix, owner, pieces, words
from loamgrid.llm.components import components
from loamgrid.llm.tables import settle

SHINGLE, K = 5, 48
NEED, OF = 75, 100
#: Estimates below are taken for unlike; at the threshold four standard deviations lie between.
FLOOR = 0.5
#: Sketch values that two linked sets share at least, of ``K``.
SHARED = 22
#: Members of each list that all others are paired with first, and the size of blocks after that.
HUBS = 2
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, how many before each text)."""
    buf = _FOLD[buf]
    starts, stops, bounds = words(buf, offs)
    n = np.diff(bounds)
    w, doc = Hasher(buf).ranges(starts, stops), owner(bounds)
    # A window ends with its text, so short texts give one window of all their words.
    first = np.flatnonzero((np.arange(len(w)) - bounds[:-1][doc] == 0) | (np.arange(len(w)) + size <= bounds[1:][doc]))
    last = bounds[1:][doc[first]]
    key = np.zeros(len(first), np.uint64)
    for i in range(size):
        at = first + i
        inside = at < last
        key = np.where(inside, mix(key * np.uint64(31) + w[np.minimum(at, max(len(w) - 1, 0))] + np.uint64(i)), key) if len(w) else key
    key, doc = key.view(np.int64), doc[first]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in pieces(batch, "t"):
            sets, at = shingle_sets(buf, offs)
            n = np.diff(at)
            h = mix(sets.view(np.uint64))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (h, mix(h + np.uint64(1)))]
            keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            take = np.minimum(n, k)
            ends = np.concatenate([[0], np.cumsum(take)])
            low = sets[np.repeat(at[:-1] - ends[:-1], take) + np.arange(ends[-1])]
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(n), pa.array(keys[0]), pa.array(keys[1]), sketch], [*rows.schema.names[:-1], "n", "s1", "s2", "sketch"])


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, row: str = "row") -> DataFrame:
    """row (its number in the column ``row``), doc_id, n (set size), s1 and s2 (identity of the set), sketch; written once."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("t"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    got = src.mapInArrow(lambda b: _sketches(b, k), f"{names}, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")
    return settle(got, "sketches")


def rare_lists(classes: DataFrame, k: int = K, shared: int = SHARED) -> DataFrame:
    """value, node, n: each class's rarest sketch values, of those that other classes have too."""
    rows = classes.select("node", "n", F.explode("sketch").alias("value"))
    common = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n = F.col("n")
    small = F.greatest(n - F.ceil(n * NEED / OF) + 1, n - (k - F.floor(F.lit(k) * (OF - NEED) / NEED)) + 1)
    prefix = F.when(n <= k, small).otherwise(k - shared + 1)
    w = Window.partitionBy("node").orderBy("df", "value")
    kept = rows.join(common, "value").withColumn("place", F.row_number().over(w)).withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("node")))
    alone = F.least(n, F.lit(k)) - F.col("seen")
    return kept.where(alone + F.col("place") <= prefix).select("value", "node", "n")


def _near_in_size(a: str, b: str):
    return (F.col(a) * OF >= F.col(b) * NEED) & (F.col(b) * OF >= F.col(a) * NEED)


def likely(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Pairs whose union sketch estimates a similarity not far below the threshold, with the estimate."""
    s = classes.select(F.col("node"), F.col("sketch"))
    got = pairs.join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    est = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return got.select("a", "b", est.alias("est")).where(F.col("est") >= FLOOR)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [column_bytes(batch.column(i)) for i in (2, 3)]
        ok = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            x, y = (shingle_sets(buf[o[r] : o[r + 1]], np.array([0, o[r + 1] - o[r]]))[0] for buf, o in both)
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[r] = OF * common >= NEED * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    got = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    return settle(got.select("a", "b", "ta", "tb").mapInArrow(_linked, "a bigint, b bigint"), "links")


def placed_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the root of each row's node."""
    return settle(nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """All members of each list, paired with a few members of it only."""
    hubs = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n")) for i in range(HUBS)]
    got = lists.join(lists.groupBy("value").agg(F.array(*hubs).alias("hubs"), F.count(F.lit(1)).alias("c")).where("c > 1"), "value")
    got = got.select(F.explode("hubs").alias("hub"), "node", "n").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    return got.where((F.col("a") != F.col("b")) & _near_in_size("na", "nb")).select("a", "b").distinct()


def units(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """What still stands apart: for each list's largest component ``main`` all members of the lists it leads, in blocks.

    Columns: main, i, j (a pair of blocks), node, root, n. Any two nodes of different components that share a list
    meet in exactly the block pairs of its unit; blocks hold about ``BLOCK`` nodes or ``BLOCK_SHINGLES`` shingles.
    """
    at = lists.join(placed, "node")
    sizes = at.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("value").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("value", "main")
    inside = F.col("root") == F.col("main")
    nodes = settle(at.join(main, "value").groupBy("main", "node").agg(F.first("root").alias("root"), F.first("n").alias("n")), "units")
    parts = lambda c: F.ceil(F.greatest(F.sum(c.cast("long")) / BLOCK, F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    count = nodes.groupBy("main").agg(parts(~inside).alias("outer"), parts(inside).alias("inner"))
    spot = F.pmod(F.xxhash64("node"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = nodes.join(count, "main").withColumn("block", F.when(inside, F.col("outer") + spot).otherwise(spot))
    # Block pairs (i, j), i among the outer ones, i <= j.
    ahead = F.when(F.col("block") < F.col("outer"), F.transform(F.sequence("block", F.col("outer") + F.col("inner") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))))
    behind = F.transform(F.sequence(F.lit(0), F.least("block", F.col("outer") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    return rows.select("main", "node", "root", "n", F.explode(F.array_distinct(F.concat(F.coalesce(ahead, F.array().cast("array<struct<i:int,j:int>>")), behind))).alias("p"), "block").select("main", "p.i", "p.j", "block", "node", "root", "n")


def _unit_links(node: np.ndarray, root: np.ndarray, block: np.ndarray, i: int, j: int, texts: list[np.ndarray], sketches: list[np.ndarray], k: int, shared: int) -> list[tuple[int, int]]:
    """Links between different components across blocks i and j, one for each node and other component."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    n = np.array([len(t) for t in texts])

    def overlaps(of: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of all intersections, as a product of membership matrices over the values both sides have."""
        xa, xb = (np.repeat(np.arange(len(s)), [len(of[r]) for r in s]) for s in (a, b))
        va, vb = (np.concatenate([of[r] for r in s]) for s in (a, b))
        both = np.intersect1d(va, vb)
        total = np.zeros((len(a), len(b)), np.float32)
        pa_, pb_ = np.searchsorted(both, va), np.searchsorted(both, vb)
        oka, okb = (np.take(both, p, mode="clip") == v if len(both) else np.zeros(len(v), bool) for p, v in ((pa_, va), (pb_, vb)))
        for lo in range(0, len(both), 4096):
            ma, mb = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
            for m, x, p, ok in ((ma, xa, pa_, oka), (mb, xb, pb_, okb)):
                use = ok & (p >= lo) & (p < lo + 4096)
                m[x[use], p[use] - lo] = 1
            total += ma @ mb.T
        return total

    na, nb = n[left][:, None], n[right][None]
    apart = (root[left][:, None] != root[right][None]) & (na * OF >= nb * NEED) & (nb * OF >= na * NEED)
    if i == j:
        apart &= left[:, None] < right[None]
    if not apart.any():
        return []
    least = np.where(np.maximum(na, nb) <= k, np.ceil((na + nb) * NEED / (OF + NEED)), shared)
    apart &= overlaps(sketches, left, right) >= least
    ra, rb = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
    if not len(ra):
        return []
    common = np.rint(overlaps(texts, left[ra], right[rb])).astype(np.int64)
    ok = apart[np.ix_(ra, rb)] & (OF * common >= NEED * (n[left[ra]][:, None] + n[right[rb]][None] - common))
    out, seen = [], set()
    for x, y in zip(*np.nonzero(ok)):
        a, b = left[ra[x]], right[rb[y]]
        key = (root[a], root[b])
        if key not in seen:
            seen.add(key)
            out.append((int(node[a]), int(node[b])))
    return out


def unit_links(rows: DataFrame, texts: DataFrame, classes: DataFrame, k: int = K, shared: int = SHARED) -> DataFrame:
    """All links that are left: whole sets of each pair of blocks are held against one another inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            buf, offs = column_bytes(t.column("t"))
            sets, at = shingle_sets(buf, offs)
            low = [np.array(x.values) for x in t.column("sketch")]
            num = {c: t.column(c).to_numpy() for c in ("node", "root", "block")}
            got = _unit_links(num["node"], num["root"], num["block"], now[1], now[2], [sets[a:b] for a, b in zip(at[:-1], at[1:])], low, k, shared)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a].tolist())
                if held and key != now:
                    yield done()
                    held.clear()
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    full = rows.join(texts, "node").join(classes.select("node", "sketch"), "node")
    full = full.select("main", "i", "j", "block", "node", "root", "t", "sketch").repartition("main", "i", "j").sortWithinPartitions("main", "i", "j")
    return settle(full.mapInArrow(run, "a bigint, b bigint"), "links")


def texts_of(numbered: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the given classes, each that of its smallest row."""
    return settle(numbered.select(F.col("row").alias("node"), "t").join(nodes, "node", "left_semi"), "texts")


def placed_classes(numbered: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """node (smallest row), s1, s2, n, doc_id and root of every class of equal sets in the sketch table ``rows``, whose
    rows carry the numbers of ``numbered`` (row, doc_id, t)."""
    full = rows.where("n > 0")
    heads = full.groupBy("s1", "s2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("head"))
    heads = settle(heads.select("s1", "s2", "n", F.col("head.row").alias("node"), F.col("head.doc_id").alias("doc_id")), "classes")
    classes = full.select("row", "sketch").join(heads, F.col("row") == F.col("node")).drop("row")
    lists = settle(rare_lists(classes, k), "lists")
    nodes = settle(lists.select("node").distinct(), "nodes")
    texts = texts_of(numbered, nodes)

    # Everybody against a few of each list, best estimate first.
    pairs = settle(likely(hub_pairs(lists), classes, k), "pairs")
    links = confirmed(pairs.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"), texts)
    placed = placed_nodes(nodes, links)

    # The rest, without exception.
    stars = placed.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = stars.union(unit_links(units(lists, placed), texts, classes, k))

    return placed_nodes(heads.select("node", "s1", "s2", "n", "doc_id"), links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    numbered = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("t")), "numbered")
    rows = sketch_table(numbered, "doc_id", "t", k, "row")
    roots = placed_classes(numbered, rows, k)
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = roots.join(least, "root").select("s1", "s2", "n", "component_id")
    got = rows.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    got = got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id, and every row without words.

    Rows are numbered and written first: a number names one row, which an id that is null or repeated does not.
    """
    numbered = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "numbered")
    src = numbered.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("t"))
    rows = sketch_table(src, "doc_id", "t", k, "row")
    roots = placed_classes(src, rows, k)
    first = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
    kept = settle(first.select(F.col("first.node").alias("row")).union(rows.where("n = 0").select("row")), "kept")
    return numbered.join(kept, "row", "left_semi").select("doc.*")
