"""Phrase mining with a bidirectional FM-index over word ids in each shard.

Texts are gathered into shards of one language and a bounded size; a shard is a sequence of word ids with breaks
between pieces. Words too rare to be in any phrase become breaks, which changes no wanted count: a phrase is never more
frequent than one of its words. A shard's index holds the Burrows-Wheeler transforms of the sequence and of its reverse,
sorted as deep as the longest phrase. Synchronised intervals are extended to the left and to the right by every symbol
that occurs there, all intervals of a level together, which enumerates each phrase once with its count in the shard.
Spark sums the counts over shards.

Only word counts, phrases with their shard counts and, per shard, the numbers of its own words are shuffled; sums
combine map-side, and each shard holds a phrase once, however frequent it is.

Defined cases: null text is empty, null language is ``und``; words of any length count; repeated rows count each;
a table without words gives no phrase. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.arrays import gather, mix, pieces
from loamgrid.llm.curve_packing import stream_starts
from loamgrid.llm.tables import settle
from loamgrid.llm.tokens import SHORT, WordTable

#: Text bytes of a shard, and of all shards that a task fills at a time.
SHARD_BYTES, HELD_BYTES = 1 << 22, 1 << 24
#: Bits of the table of phrases that may be extended; a multiple of 2^19 and a power of two.
FILTER_BITS = 1 << 26

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INK = ~_BREAK
_INK[[32, 9]] = False


def word_sequence(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers from 1 with 0 between pieces, the words in order of their number, their counts)."""
    buf = _FOLD[buf]
    ink = _INK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first, last = ink & edge[:-1], ink & edge[1:]
    first[1:] |= ink[1:] & ~ink[:-1]
    last[:-1] |= ink[:-1] & ~ink[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    size = stop - start
    names = WordTable.names(buf, start, np.minimum(size, SHORT))
    long = np.flatnonzero(size > SHORT)
    if len(long):  # longer words are told apart by all their bytes
        data, seen = buf.tobytes(), {}
        names[long] = 0
        names[long, 0] = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(start[long].tolist(), stop[long].tolist())]
        names[long, 2] = np.uint64(0xFF) << np.uint64(56)
    hashes = WordTable.scatter(names)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if (same & (names[order][1:] != names[order][:-1]).any(axis=1)).any():
        order = np.lexsort((names[:, 0], names[:, 1], names[:, 2]))
        same = (names[order][1:] == names[order][:-1]).all(axis=1)
    new = np.concatenate([[True], ~same])
    number = np.empty(len(start), np.int64)
    number[order] = np.cumsum(new)
    one = order[new]
    ends = np.concatenate([[0], np.cumsum(size[one])])
    spelt = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(ends), pa.py_buffer(buf[gather(start[one], size[one])])]).cast(pa.string())

    # A break stands before each word that begins a piece.
    breaks = np.concatenate([[0], np.cumsum(_BREAK[buf])])
    row = np.searchsorted(offs, start, "right")
    begins = np.concatenate([[True], (breaks[start[1:]] > breaks[stop[:-1]]) | (row[1:] != row[:-1])])
    sequence = np.zeros(len(start) + int(begins.sum()), np.int64)
    sequence[np.arange(len(start)) + np.cumsum(begins)] = number
    return sequence, spelt, np.bincount(number, minlength=len(one) + 1)[1:]


class Side:
    """One direction of the index: the symbols before the suffixes, which are sorted by ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        n, bits = len(text), max(1, int(symbols).bit_length())
        if bits * depth <= 63:
            key = np.zeros(n, np.int64)
            for k in range(depth):
                key <<= bits
                key[: n - k] |= text[k:]
            order = np.argsort(key)
            del key
        else:
            order = np.lexsort([np.concatenate([text[k:], np.zeros(min(k, n), text.dtype)]) for k in range(depth)][::-1])
        order -= 1
        self.before = text[order]  # the text begins with a break, so its end stands before it
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.n = n
        self.seats: np.ndarray | None = None

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the first ``at`` suffixes."""
        if self.seats is None:
            self.seats = np.sort(self.before.astype(np.int64) * (self.n + 1) + np.arange(self.n))
        return np.searchsorted(self.seats, symbol * (self.n + 1) + at) - np.searchsorted(self.seats, symbol * (self.n + 1))


class WordIndex:
    """Both directions over a sequence that begins and ends with a break (0)."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        self.left, self.right = Side(text, depth, symbols), Side(text[::-1], depth, symbols)
        self.symbols = symbols

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, count, interval starts in either direction) of all words that occur."""
        first = self.left.first
        count = np.diff(first)
        word = np.flatnonzero(count)
        word = word[word > 0]
        return word, count[word], first[word], first[word]

    def extend(self, side: Side, lo: np.ndarray, count: np.ndarray, other: np.ndarray, onward: bool = True) -> tuple[np.ndarray, ...]:
        """(interval, symbol, count, start on this side, start on the other) of every extension, breaks left out.

        Within an interval the other direction orders the extensions by their symbol, so its starts are running counts.
        """
        of = np.repeat(np.arange(len(lo)), count)
        pair = of * (self.symbols + 1)
        del of
        pair += side.before[gather(lo, count)]
        pair.sort()
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(pair)))
        of, symbol = np.divmod(pair[new], self.symbols + 1)
        before = np.cumsum(count) - count
        far = other[of] + new - before[of]
        word = symbol > 0
        of, symbol, n, far = of[word], symbol[word], n[word], far[word]
        near = side.first[symbol] + side.rank(symbol, lo[of]) if onward else far
        return of, symbol, n, near, far


def phrases(text: np.ndarray, depth: int, symbols: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of all phrases of ``depth`` words: intervals are extended first to the left, then to the right.

    With ``known``, a test of shorter phrases, only those of which every shorter part passes.
    """
    index = WordIndex(text, depth, symbols)
    word, count, near, far = index.words()
    of, symbol, count, _, near = index.extend(index.left, near, count, far, onward=False)
    rows = np.column_stack([symbol, word[of]])
    for level in range(3, depth + 1):
        if known is not None:
            keep = known(rows)
            rows, count, near = rows[keep], count[keep], near[keep]
        of, symbol, count, near, _ = index.extend(index.right, near, count, near, onward=level < depth)
        rows = np.column_stack([rows[of], symbol])
        if known is not None:
            keep = known(rows[:, 1:])
            rows, count, near = rows[keep], count[keep], near[keep]
    return rows, count


def _bit(ids: np.ndarray) -> np.ndarray:
    """Place of a phrase, given by its word ids, in a filter."""
    h = np.full(len(ids), np.uint64(ids.shape[1]))
    for k in range(ids.shape[1]):
        h = mix(h ^ ids[:, k].astype(np.uint64))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def phrase_filter(found: DataFrame, names: list[str]) -> np.ndarray:
    """A bit for every phrase of ``found``, packed; of fixed size, whatever the number of phrases."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(np.column_stack([batch.column(k).to_numpy() for k in range(len(names))])))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 19), pa.array(at)], ["chunk", "at"])

    def fill(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 19, bool)
        out[table.column("at").to_numpy() & (1 << 19) - 1] = True
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    got = found.select(*names).mapInArrow(bits, "chunk bigint, at bigint").distinct().groupBy("chunk").applyInArrow(fill, "chunk bigint, bits binary")
    out = np.zeros((FILTER_BITS >> 19, 1 << 16), np.uint8)
    for row in got.collect():  # FILTER_BITS / 8 bytes in all
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def shards(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SHARD_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """shard, lang, words and their counts, ids (little-endian unsigned 32-bit, 0 between pieces); written once."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        open_: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        used: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            nonlocal number
            texts = open_.pop(name)
            del used[name]
            buf, sizes = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
            ids, spelt, counts = word_sequence(buf, np.concatenate([[0], np.cumsum(sizes)]))
            one = np.array([0, len(spelt)], np.int32)
            row = [pa.array([part << 32 | number]), pa.array([name], pa.string()), pa.ListArray.from_arrays(pa.array(one), spelt), pa.ListArray.from_arrays(pa.array(one), pa.array(counts, pa.int64())), pa.array([ids.astype("<u4").tobytes()], pa.binary())]
            number += 1
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for batch in batches:
            for rows, buf, offs in pieces(batch, "t", size >> 2):
                names = rows.column(0).dictionary_encode()
                codes, sizes = names.indices.to_numpy(), np.diff(offs)
                for code, name in enumerate(names.dictionary.to_pylist()):
                    own = np.flatnonzero(codes == code)
                    open_.setdefault(name, []).append((buf[gather(offs[own], sizes[own])], sizes[own]))
                    used[name] = used.get(name, 0) + int(sizes[own].sum())
                    if used[name] >= size:
                        yield flush(name)
                while sum(used.values()) > held:
                    yield flush(max(used, key=used.get))
        for name in list(open_):
            yield flush(name)

    src = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return settle(src.mapInArrow(run, "shard bigint, lang string, words array<string>, counts array<bigint>, ids binary"), "shards")


def word_counts(parts: DataFrame) -> DataFrame:
    """lang, word, f."""
    pair = F.explode(F.arrays_zip("words", "counts"))
    return parts.select("lang", pair.alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))


def phrase_counts(parts: DataFrame, words: DataFrame, depth: int, least: int) -> DataFrame:
    """w1 ... (ids of ``words``: lang, word, id; 0 behind shorter phrases) and f of phrases of 2 to ``depth`` words that
    occur ``least`` times or more.

    One pass for each length. Shards leave out phrases that have a shorter part which the pass before found too rare;
    a bit table of fixed size tells, which may let a phrase too many through but never keeps one back.
    """
    spark = parts.sparkSession
    places = parts.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    own = places.groupBy("shard").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))
    ready = settle(parts.select("shard", "ids").join(own, "shard").select("ids", "at", "id"), "sequences")
    names, every, told = [f"w{k + 1}" for k in range(depth)], None, {}
    for size in range(2, depth + 1):
        got = ready.mapInArrow(_counter(size, dict(told)), ", ".join(f"{n} bigint" for n in [*names[:size], "f"]))
        found = settle(got.groupBy(*names[:size]).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
        if size < depth:
            told[size] = spark.sparkContext.broadcast(phrase_filter(found, names[:size]))
        full = found.select(*names[:size], *(F.lit(0).cast("long").alias(n) for n in names[size:]), "f")
        every = full if every is None else every.union(full)
    return every


def _counter(size: int, told: dict[int, Broadcast]):
    """The phrases of ``size`` words of each shard, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[r].as_py(), "<u4")
                at, number = (batch.column(c)[r].values.to_numpy() for c in (1, 2))
                if not len(at):
                    continue
                local = np.zeros(int(max(ids.max(initial=0), at.max() + 1)) + 1, np.int32)
                local[at + 1] = np.arange(1, len(at) + 1)
                text = local[ids]
                # One break between what can be phrases is enough.
                text = np.pad(text[(text > 0) | np.concatenate([[False], text[:-1] > 0])], 1)
                globally = np.concatenate([[0], number])

                def known(rows: np.ndarray) -> np.ndarray:
                    bit = _bit(globally[rows])
                    return told[rows.shape[1]].value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 > 0

                rows, count = phrases(text, size, len(at), known if size > 2 else None)
                for lo in range(0, len(rows), 1 << 16):
                    cut = globally[rows[lo : lo + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(cut[:, k])) for k in range(size)), pa.array(count[lo : lo + (1 << 16)])], [*(f"w{k + 1}" for k in range(size)), "f"])

    return run


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)); integer division of decimals is exact below 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    over = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by their lowest-scoring cut, without
    those of which ``share`` per cent or more lie inside one longer phrase."""
    parts = shards(docs, lang, text)
    counted = settle(word_counts(parts), "words")
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    often = counted.where(F.col("f") >= least)
    words = settle(stream_starts(often.withColumn("one", F.lit(1).cast("long")), ["lang", "word"], "one").select("lang", "word", "f", (F.col("start") + 1).alias("id")), "vocabulary")
    names = [f"w{k + 1}" for k in range(most_words)]
    found = phrase_counts(parts, words, most_words, least)

    def padded(cols: list[str]) -> list[Column]:
        return [F.col(c).alias(n) for c, n in zip(cols, names)] + [F.lit(0).cast("long").alias(n) for n in names[len(cols) :]]

    # The most frequent phrase that is one word longer; still longer ones are no more frequent.
    inner = None
    for size in range(3, most_words + 1):
        of = found.where(_size(names) == size)
        for cols in (names[: size - 1], names[1:size]):
            one = of.select(*padded(cols), F.col("f").alias("within"))
            inner = one if inner is None else inner.union(one)
    left = found
    if inner is not None:
        inner = inner.groupBy(*names).agg(F.max("within").alias("within"))
        left = found.join(inner, names, "left").where(F.col("within").isNull() | (100 * F.col("within") < share * F.col("f"))).drop("within")
    left = settle(left.withColumnRenamed("f", "a"), "candidates")

    # Both parts of every cut.
    cuts = None
    for size in range(2, most_words + 1):
        of = left.where(_size(names) == size)
        for k in range(1, size):
            got = of.select(*names, "a", F.lit(k).alias("k"))
            for out, cols in (("l", names[:k]), ("r", names[k:size])):
                if len(cols) == 1:
                    side = words.select(F.col("id").alias("__0"), F.col("f").alias(out))
                else:
                    side = found.where(_size(names) == len(cols)).select(*(F.col(n).alias(f"__{i}") for i, n in enumerate(names[: len(cols)])), F.col("f").alias(out))
                on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(cols)]
                got = got.join(side, on).select(*got.columns, out)
            cuts = got if cuts is None else cuts.union(got)
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy(*names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    got = best.select(*names, "a", "c.l", "c.r", "c.score")
    for k, n in enumerate(names):
        side = words.select(F.col("id").alias("__id"), F.col("word").alias(f"word{k}"), *([F.col("lang").alias("lang")] if not k else []))
        got = got.join(side, F.col(n) == F.col("__id"), "inner" if k < 2 else "left").drop("__id")
    got = got.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(most_words))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return got.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _size(names: list[str]) -> Column:
    return sum(((F.col(n) != 0).cast("int") for n in names[1:]), F.lit(1))
