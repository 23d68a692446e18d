"""Prefix trie of conversations by truncation peeling.

A node is a sequence of first turns; conversations that begin with it are its members. Every prefix gets a key of fixed
size: the running sum of SHA-256 numbers of its turns, each taken together with its place. Conversations of equal
turns are one sequence with a weight and the smallest id.

Below the deepest node that two different sequences share, every node belongs to one sequence and is a link of a chain,
which closed formulas settle. From that depth up the trie is peeled: in each round the sequences that end there join
the nodes that survive, the last turn is stripped, and rows that now agree are one node; the grouping that finds a node
also adds up its members, children, leaves and savings. So the number of rounds is the length of the longest prefix that
two different conversations share, however long a single conversation is.

Places and running sums are computed over even ranges of (conversation, turn), so a conversation that holds a third of
all rows spreads over tasks. Groupings combine map-side. The ids of equal conversations are written as text by range
and digested range after range, which keeps memory bounded; the order of a digest makes that last step one stream for
one group of equal conversations.

Defined cases: turns are ordered by turn (null first), then role and text; null role or text is empty; rows without a
conversation id belong to no conversation and are left out; equal rows are turns of their own; a table without
conversations gives no node. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.tables import settle
from loamgrid.operators.ordering import in_ranges

KEY = "decimal(38,0)"


def running_sums(df: DataFrame, by: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums within ``by``. Ranges of (by, order) are summed apart and moved on by the ranges before."""
    for name, value in sums.items():
        df = df.withColumn(f"__{name}", value)
    cut = in_ranges(df, [by, *order])
    total = cut.groupBy(by, "__b").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ranges that one group reaches
    total = total.select(F.col(by).alias("__by"), F.col("__b").alias("__c"), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    inside = Window.partitionBy(by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = cut.select("*", *(F.sum(f"__{n}").over(inside).alias(f"__i_{n}") for n in sums))
    got = got.join(total, (F.col(by) == F.col("__by")) & (F.col("__b") == F.col("__c")))
    old = [c for c in df.columns if not c.startswith("__")]
    return got.select(*old, *((F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums))


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), role and text of every turn."""
    src = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return running_sums(src, "conv", ["turn", "role", "text"], {"place": F.lit(1).cast("long")}).drop("turn")


def rebuilt(rows: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Turns of conversations that begin like the first of their group: the first h turns of conversation c - c % group,
    then their own after the first h, with h = crc32(c) % most. Conversations left without a turn have one row of
    place null."""
    own = settle(turns(rows), "turns")
    ids = own.select("conv").distinct()
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    # Only the first ``most`` - 1 turns of a conversation are ever taken over, by at most ``group`` conversations.
    first = own.where((F.col("conv") % group == 0) & (F.col("place") < most)).select(F.col("conv").alias("base"), "place", "role", "text")
    taken = ids.withColumn("base", F.col("conv") - F.col("conv") % group).join(first, "base").where(F.col("place") <= h).select("conv", "place", "role", "text")
    both = own.where(F.col("place") > h).unionByName(taken)
    got = running_sums(both, "conv", ["place", "role", "text"], {"now": F.lit(1).cast("long")}).select("conv", F.col("now").alias("place"), "role", "text")
    return got.unionByName(ids.join(both.select("conv").distinct(), "conv", "left_anti"), allowMissingColumns=True)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, place, key of the prefix that ends there, bytes of its last text and ``sum_bytes`` up to it. A row of
    place null stands for a conversation without turns and is left out."""
    sha = F.sha2(F.concat_ws("\n", F.col("place").cast("string"), F.length(F.encode("role", "utf-8")).cast("string"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring(sha, at, 12), 16, 10).cast("decimal(16,0)").cast(KEY)
    number = (part(1) * F.lit(1 << 48).cast("decimal(16,0)") + part(13)).cast("decimal(30,0)")
    src = rows.where("place is not null").select("conv", "place", F.octet_length("text").cast("long").alias("bytes"), number.alias("number"))
    got = running_sums(src, "conv", ["place"], {"key": F.col("number"), "sum_bytes": F.col("bytes")})
    return settle(got.select("conv", "place", F.col("key").cast(KEY).alias("key"), "bytes", "sum_bytes"), "prefixes")


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, key and sha256 of the ids of the conversations that end there, ascending, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for depth, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (depth, key) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, key), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "key", "sha"), o)) for o in out], schema=_DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "key", "sha"), (*now, state.hexdigest())))], schema=_DIGEST)

    cut = in_ranges(ends.select("depth", "key", "conv"), ["depth", "key", "conv"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = cut.groupBy("depth", "key", "__b").agg(text.alias("ids"))
    lists = lists.repartition("depth", "key").sortWithinPartitions("depth", "key", "__b").select("depth", "key", "ids")
    return lists.mapInArrow(run, f"depth bigint, key {KEY}, sha string")


_DIGEST = pa.schema([("depth", pa.int64()), ("key", pa.decimal128(38, 0)), ("sha", pa.string())])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations given as turns (conv, place from 1, role, text; place null: a conversation without
    turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    rows = settle(rows, "conversations")
    prefix = prefixes(rows)
    none = F.lit(0).cast(KEY)

    # One row per conversation, then per sequence.
    last = prefix.groupBy("conv").agg(F.max(F.struct("place", "key", "sum_bytes")).alias("e")).select("conv", F.col("e.place").alias("depth"), F.col("e.key").alias("key"), F.col("e.sum_bytes").alias("total"))
    empty = rows.where("place is null").select("conv", F.lit(0).cast("long").alias("depth"), none.alias("key"), F.lit(0).cast("long").alias("total"))
    ends = settle(last.unionByName(empty), "ends")
    if ends.isEmpty():
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    whole = settle(ends.groupBy("depth", "key", "total").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "sequences")

    # From which depth on nothing is shared by different sequences.
    of = prefix.join(whole.select("conv", F.col("depth").alias("size"), F.col("key").alias("full"), "n", "total"), "conv")
    of = settle(of, "paths")  # prefixes of one conversation of each sequence
    full = F.struct("size", "full")
    shared = of.groupBy("place", "key").agg(F.min(full).alias("a"), F.max(full).alias("b")).where("a != b")
    deepest = shared.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]

    # Chains below it.
    saved = (F.col("n") - 1) * (F.col("total") - F.col("sum_bytes") + F.col("bytes"))
    chain = of.where(F.col("place") > deepest).select(
        "conv", F.col("place").alias("depth"), "key", "n", (F.col("place") < F.col("size")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), saved.alias("saved"),
        F.when(F.col("place") > deepest + 1, F.col("conv")).alias("parent"),
    )

    # Every sequence with its way through the shared part; the first rows to peel are the heads of the chains.
    way = of.where(F.col("place") <= deepest).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "key", "bytes"))).alias("way"))
    state = ("conv", "n", "way", "child", "leaves", "saved")
    seqs = settle(whole.join(way, "conv", "left"), "ways")
    tail = (F.col("n") - 1) * (F.col("total") - _sum_bytes("way"))
    heads = seqs.where(F.col("depth") > deepest).select("conv", "n", "way", F.lit(1).alias("child"), F.lit(1).cast("long").alias("leaves"), tail.alias("saved"))
    nodes, alive = [], heads
    for depth in range(deepest, -1, -1):
        ending = seqs.where(F.col("depth") == depth).select("conv", "n", "way", F.lit(0).alias("child"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        rows_now = alive.select(*state).unionByName(ending.select(*state))
        if depth:
            here = F.element_at("way", depth)
            rows_now = rows_now.withColumn("key", here["key"]).withColumn("bytes", here["bytes"])
        else:
            rows_now = rows_now.withColumn("key", none).withColumn("bytes", F.lit(0).cast("long"))
        found = rows_now.groupBy("key").agg(
            F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("way").alias("way"), F.first("bytes").alias("bytes"),
            F.sum("child").cast("long").alias("children"), F.sum("leaves").alias("below"), F.sum("saved").alias("deeper"),
        )
        found = found.select("conv", F.lit(depth).cast("long").alias("depth"), "key", "n", "way", "children", F.greatest("below", F.lit(1).cast("long")).alias("leaves"), (F.col("deeper") + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
        found = settle(found, "nodes")
        above = F.element_at("way", depth - 1)["key"] if depth > 1 else none
        nodes.append(found.select("conv", "depth", "key", "n", "children", "leaves", "saved", F.lit(None).cast("long").alias("parent"), above.alias("above")))
        alive = found.withColumn("child", F.lit(1))

    # Parents' conversations: the root's and a chain's are known, others are looked up by key.
    heads_above = seqs.where(F.col("depth") > deepest).select("conv", F.element_at("way", -1)["key"].alias("above")) if deepest else None
    first = chain.where(F.col("depth") == deepest + 1)
    first = first.join(heads_above, "conv") if deepest else first.withColumn("above", none)
    peeled = reduce(DataFrame.unionByName, nodes)
    open_ = peeled.unionByName(first)
    keys = peeled.select(F.col("depth").alias("d"), F.col("key").alias("k"), F.col("conv").alias("up"))
    placed = open_.join(keys, (F.col("depth") - 1 == F.col("d")) & (F.col("above") == F.col("k")), "left").withColumn("parent", F.col("up"))
    every = placed.select("conv", "depth", "key", "n", "children", "leaves", "saved", "parent").unionByName(chain.where(F.col("depth") > deepest + 1))
    got = every.join(ends_digest(ends), ["depth", "key"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )


def _sum_bytes(way: str) -> Column:
    return F.aggregate(F.coalesce(F.transform(way, lambda x: x["bytes"]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
