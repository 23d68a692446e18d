"""Names looked up in texts: aliases of a gazetteer, and names that contain one another."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.text import strip_admin_suffix
from loamgrid.session import write_and_read

#: Bytes of names and targets that one automaton holds; smaller gazetteers are broadcast.
SHARD_BYTES = 4 << 20
#: Bytes of texts that meet one shard of a larger gazetteer at a time.
BLOCK_BYTES = 64 << 20

HIT = "target string, score long"


def automaton(rows: Iterable[tuple[str, str | None, int]]):
    """Automaton over (alias, target, score), one row for each alias; None for no rows."""
    a = ahocorasick.Automaton()
    for alias, target, score in rows:
        a.add_word(alias, (-score, alias, target))
    if not len(a):
        return None
    a.make_automaton()
    return a


def best_hits(a, texts: pa.Array) -> Iterator[tuple[int, str, str | None]]:
    """For each text the hit with the highest score, then the smallest alias; None for no hit."""
    for t in texts:
        s = t.as_py()
        found = None
        if s and a is not None:
            found = min((v for _, v in a.iter(s)), key=lambda v: v[:2], default=None)
        yield found


def alias_match(df: DataFrame, text: str, aliases: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``target`` and ``score`` of the best alias in a text by (level + length, alias, target); NULL for none.

    ``aliases`` holds alias, target, level; empty aliases and ones without a level never match, of repeated ones the
    best counts. Texts are scanned by an automaton over all aliases at once. A gazetteer up to ``shard_bytes`` (its size
    is read first) is broadcast and texts are mapped in place. A larger one is cut into shards of about that size by
    the hash of the alias; every block of texts meets every shard, and the best hit of the shards counts.
    """
    score = (F.col("level") + F.length("alias")).cast("long")
    a = aliases.filter((F.length("alias") > 0) & F.col("level").isNotNull())
    a = a.groupBy("alias").agg(F.min(F.struct((-score).alias("neg"), "target")).alias("b")).select("alias", F.col("b.target").alias("target"), (-F.col("b.neg")).alias("score"))
    a = write_and_read(a, "aliases")
    size = a.agg(F.sum(F.octet_length("alias") + F.coalesce(F.octet_length("target"), F.lit(0)) + 8)).first()[0] or 0
    if size <= shard_bytes:
        return _mapped(df, text, a)
    return _sharded(df, text, a, math.ceil(size / shard_bytes), block_bytes)


def _mapped(df: DataFrame, text: str, a: DataFrame) -> DataFrame:
    names = df.sparkSession.sparkContext.broadcast([tuple(r) for r in a.collect()])

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(names.value)
        for b in batches:
            got = list(best_hits(found, pa.Array.from_pandas(b, type=pa.string())))
            yield pd.DataFrame({"target": [g and g[2] for g in got], "score": pd.array([g and -g[0] for g in got], "Int64")})

    # Annotations are text in this module; the type hints are read from the objects.
    hits.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    hits = F.pandas_udf(hits, HIT)
    return df.withColumn("__h", hits(F.col(text).cast("string"))).select(*df.columns, "__h.target", "__h.score")


def _sharded(df: DataFrame, text: str, a: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    rows = write_and_read(df.withColumn("__id", F.monotonically_increasing_id()), "texts")
    full = rows.filter(F.length(F.col(text)) > 0).select("__id", F.col(text).cast("string").alias("__t"))
    blocks = max(1, math.ceil((full.agg(F.sum(F.octet_length("__t"))).first()[0] or 0) / block_bytes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = full.select("__id", "__t", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    g = a.select("*", F.pmod(F.xxhash64("alias"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))

    def scan(texts: pa.Table, names: pa.Table) -> pa.Table:
        found = automaton(zip(*(names.column(c).to_pylist() for c in ("alias", "target", "score"))))
        got = [(i.as_py(), *h) for i, h in zip(texts.column("__id"), best_hits(found, texts.column("__t"))) if h]
        cols = list(zip(*got)) or [[]] * 4
        return pa.table({n: pa.array(c, ty) for n, c, ty in zip(("__id", "neg", "alias", "target"), cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))})

    hit = t.groupBy("shard", "block").cogroup(g.groupBy("shard", "block")).applyInArrow(scan, "__id long, neg long, alias string, target string")
    best = hit.groupBy("__id").agg(F.min(F.struct("neg", "alias", "target")).alias("__h"))
    return rows.join(best, "__id", "left").select(*df.columns, F.col("__h.target").alias("target"), (-F.col("__h.neg")).alias("score"))


def pieces(name: Column) -> Column:
    """Distinct pieces of one and of two characters of a name; none of an empty one."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))
    return F.when(F.length(name) > 1, F.array_distinct(F.concat(cut(1), cut(2)))).when(F.length(name) == 1, F.array(name)).otherwise(F.array().cast("array<string>"))


def contained_in(short: DataFrame, needle: str, long: DataFrame, haystack: str, salts: int = 16) -> DataFrame:
    """Rows of both sides where the needle lies inside the haystack; columns must not clash.

    A needle is looked up by the rarest of its two-character pieces (of its one character, if it has no more) among the
    pieces of all haystacks, so only pairs that share the needle's rarest piece reach the test. A needle with a piece
    that no haystack holds is left out before the join. Needles are salted, haystacks repeated ``salts`` times
    for pieces that more than ``salts`` times the mean of needles look up. Empty and NULL needles match nothing.
    """
    hay = long.select("*", F.explode(pieces(F.col(haystack))).alias("__k"))
    count = hay.groupBy("__k").agg(F.count("*").alias("__n"))
    names = short.select(F.col(needle).alias("__s")).filter(F.length("__s") > 0).distinct()
    two = names.select("__s", F.explode(F.filter(pieces(F.col("__s")), lambda p: F.length(p) == F.least(F.length("__s"), F.lit(2)))).alias("__k"))
    rare = two.join(count, "__k", "left").groupBy("__s").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__k").alias("k"))).alias("r"))
    rare = write_and_read(rare.filter("r.n > 0").select("__s", F.col("r.k").alias("__k")), "rare")
    used = rare.groupBy("__k").agg(F.count("*").alias("__m"))
    busy = used.withColumn("__mean", rare.select(F.count("*") / F.greatest(F.count_distinct("__k"), F.lit(1))).scalar())
    busy = busy.select("__k", F.when(F.col("__m") > salts * F.col("__mean"), salts).otherwise(1).alias("__salts"))
    left = rare.join(busy, "__k").withColumn("__salt", F.pmod(F.xxhash64("__s"), F.col("__salts")).cast("int")).drop("__salts")
    right = hay.join(busy, "__k").select("*", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt")).drop("__salts")
    hit = left.join(right, ["__k", "__salt"]).filter(F.contains(F.col(haystack), F.col("__s"))).drop("__k", "__salt")
    return short.join(hit, short[needle] == hit["__s"]).drop("__s")


def admin_name_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (q, c) that are equal, equal without suffix, or have one stripped name inside the other.

    A name that is nothing but a suffix matches its equals only.
    """
    q = queries.select("q").distinct().withColumn("qs", strip_admin_suffix(F.col("q")))
    c = names.select("c").distinct().withColumn("cs", strip_admin_suffix(F.col("c")))
    cols = ["q", "c", "qs", "cs"]
    both = contained_in(q, "qs", c, "c").select(*cols).unionByName(contained_in(c, "cs", q, "q").select(*cols))
    both = both.unionByName(q.join(c, F.col("q") == F.col("c")).select(*cols)).distinct()
    how = F.when(F.col("q") == F.col("c"), "equal").when(F.col("qs") == F.col("cs"), "stripped").otherwise("contained")
    return both.select("q", "c", how.alias("how"))
