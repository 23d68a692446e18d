"""Bounded-space online best-fit packing of whole documents into sequences.

Only documents longer than a sequence are cut, into full sequences and a rest. Pieces are dealt by hash into groups of
bounded size, and each group is packed in one pass: a piece goes into the open sequence with the least room that still
takes it, found by one look at a bitset that has a bit for every amount of free space. A fixed number of sequences may
be open; when a new one is needed beyond that, the fullest closes first, and a full one closes at once.

What is left open at a group's end goes to a further round with fewer groups, until one group is left, so half-empty
sequences do not add up with the number of groups. A group is bounded by tokens and by pieces, whatever the documents'
lengths and ids, and no task sees more than a group. Token ids stay in one written table; rounds move numbers only.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each, by row number; a null document
id stays null; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.arrays import pieces
from loamgrid.llm.tables import settle
from loamgrid.llm.tokens import encoder

#: Sequences open at a time, and the most tokens and pieces of a group.
OPEN = 512
GROUP_TOKENS, GROUP_PIECES = 1 << 23, 1 << 18
#: Groups whose open sequences meet in one group of the next round.
MERGE = 8


class OpenBins:
    """Open sequences by free space; bit ``f`` of ``bits`` is set when one has ``f`` free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.made = 0

    def _push(self, number: int, free: int) -> None:
        at = self.by_free.setdefault(free, [])
        if not at:
            self.bits |= 1 << free
        at.append(number)
        self.count += 1

    def _pop(self, free: int) -> int:
        at = self.by_free[free]
        number = at.pop()
        if not at:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._pop(free)
        else:
            if self.count >= self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.length
            self.made += 1
        if free > size:
            self._push(number, free - size)
        return number, self.length - free

    def open_numbers(self) -> list[int]:
        return [n for at in self.by_free.values() for n in at]


def tokenised_pieces(docs: DataFrame, tokenizer: str, length: int, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian, ``width`` bytes each) of every whole text, written
    once, with a number for each row that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for rows, buf, offs in pieces(batch, "t"):
                ids, n = enc.texts(buf, offs)
                ends = np.cumsum(n + 1)
                full = np.full(int(ends[-1]), end_id, "<u4")
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                per = -(-(n + 1) // length)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * length
                size = np.minimum((n + 1)[doc] - start, length)
                at = (ends - n - 1)[doc] + start
                data = full.tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist())]
                packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(at, len(full)) * width), pa.py_buffer(full.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), packed.cast(pa.binary()), pa.array(np.full(len(doc), width, np.int32))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "width"],
                )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    got = src.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, width int")
    return settle(got.withColumn("row", F.monotonically_increasing_id()), "pieces")


def _packer(length: int, most: int, round_: int, last: bool):
    """Packs the pieces of one group; ``closed`` is false for what the next round packs anew."""

    def run(table: pa.Table) -> pa.Table:
        size, row = table.column("length").to_numpy(), table.column("row").to_numpy()
        order = np.argsort(row)  # the same result however the rows arrive
        bins = OpenBins(length, most)
        placed = np.array([bins.place(n) for n in size[order].tolist()], np.int64).reshape(-1, 2)
        number, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        number[order], offset[order] = placed[:, 0], placed[:, 1]
        closed = np.ones(bins.made, bool)
        if not last:
            closed[bins.open_numbers()] = False
        group = table.column("group")[0].as_py()
        sequence = np.int64(round_ << 58 | group << 24) + number
        return table.select(["row", "length"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("closed", pa.array(closed[number]))

    return run


def place_pieces(sizes: DataFrame, length: int, most: int = OPEN, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """row, sequence_id and offset of every row of ``sizes`` (row, length), by rounds."""
    tokens, count = sizes.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // group_tokens), -(-count // group_pieces))
    left, done, round_ = sizes.select("row", "length"), None, 0
    while True:
        of = F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(groups))
        run = _packer(length, most, round_, groups == 1)
        packed = left.withColumn("group", of).groupBy("group").applyInArrow(run, "row bigint, length bigint, sequence_id bigint, offset bigint, closed boolean")
        packed = settle(packed, "packed")
        closed = packed.where("closed").select("row", "sequence_id", "offset")
        done = closed if done is None else done.union(closed)
        if groups == 1:
            return done
        left, groups, round_ = packed.where("not closed"), -(-groups // MERGE), round_ + 1


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, id_col: str = "doc_id", text: str = "text", end_id: int = 1, most: int = OPEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves
    (little-endian, ``width`` bytes each)."""
    rows = tokenised_pieces(docs, tokenizer, length, id_col, text, end_id)
    return rows.join(place_pieces(rows.select("row", "length"), length, most, group_tokens), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, its pieces one after another."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return got.select("sequence_id", total.alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
