"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 256. A block stores its minimum and the differences to it, packed at the bit width that a
given share of them needs; the few wider ones keep their low bits in place and their high bits in an exception list.
Every block's start is indexed, so a range of ids can be read without the rest.

File: blocks | block starts (u64) | document ids (i64) | flags of null ids (u8) | ids per document (u64) | trailer
(u64 blocks, u64 documents, u64 ids, magic). Block: minimum u32, width u8, zero u8, exceptions u16, packed bits,
positions (u8), high bits (u32). All little-endian.

Documents are range-partitioned by id; each task writes files of a bounded number of ids, named by partition and
number, so running a task again writes the same files. Defined cases: null text is empty and holds the end id alone;
null document ids come first; rows with equal ids are ordered by text hash and spread over ranges; an empty table gives no file and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import files
from loamgrid.llm.arrays import gather, pieces
from loamgrid.llm.curve_packing import stream_starts
from loamgrid.llm.tokens import encoder
from loamgrid.session import scratch_path, write_and_read

BLOCK = 256
MAGIC = b"PFORIDS1"
_HEAD = 8


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[bytes, np.ndarray]:
    """(packed blocks, start of each block)."""
    nb = -(-len(ids) // BLOCK)
    if not nb:
        return b"", np.zeros(0, np.int64)
    x = np.empty(nb * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[-1]
    x = x.reshape(nb, BLOCK)
    low = x.min(1)
    d = x - low[:, None]
    bits = _bits(d)
    width = np.partition(bits, int(share * BLOCK) - 1, axis=1)[:, int(share * BLOCK) - 1]
    over = bits > width[:, None]
    n_over = over.sum(1)
    body = BLOCK // 8 * width
    size = _HEAD + body + 5 * n_over
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros((nb, _HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(nb, 4)
    head[:, 4] = width
    head[:, 6:8] = n_over.astype("<u2").view(np.uint8).reshape(nb, 2)
    out[(start[:, None] + np.arange(_HEAD)).ravel()] = head.ravel()
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        planes = np.unpackbits(d[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(planes.reshape(len(at), -1), axis=1, bitorder="little")
        out[(start[at, None] + _HEAD + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    blk, pos = np.nonzero(over)
    if len(blk):
        lists = start + _HEAD + body
        out[gather(lists, n_over)] = pos
        high = (d[blk, pos].astype(np.uint64) >> width[blk].astype(np.uint64)).astype("<u4")
        out[gather(lists + n_over, 4 * n_over)] = high.view(np.uint8)
    return out.tobytes(), start


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``start``, whole blocks."""
    nb = len(start)
    head = data[start[:, None] + np.arange(_HEAD)]
    low = head[:, :4].copy().view("<u4").ravel()
    width, n_over = head[:, 4].astype(np.int64), head[:, 6:8].copy().view("<u2").ravel().astype(np.int64)
    d = np.zeros((nb, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        packed = data[start[at, None] + _HEAD + np.arange(BLOCK // 8 * w)]
        planes = np.zeros((len(at), BLOCK, 32), np.uint8)
        planes[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        d[at] = np.packbits(planes, axis=2, bitorder="little").view("<u4")[:, :, 0]
    if n_over.any():
        lists = start + _HEAD + BLOCK // 8 * width
        blk = np.repeat(np.arange(nb), n_over)
        pos = data[gather(lists, n_over)]
        high = data[gather(lists + n_over, 4 * n_over)].view("<u4").astype(np.uint64)
        d[blk, pos] |= (high << width[blk].astype(np.uint64)).astype(np.uint32)
    return (d + low[:, None]).ravel()


def to_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    body, start = pack_blocks(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    trailer = np.array([len(start), len(counts), len(ids)], "<u8").tobytes() + MAGIC
    return b"".join([body, start.astype("<u8").tobytes(), numbers.tobytes(), null.tobytes(), counts.astype("<u8").tobytes(), trailer])


class IdFile:
    """Reads a file's documents or any range of its ids."""

    def __init__(self, data: bytes):
        if data[-8:] != MAGIC:
            raise ValueError("not an id file")
        blocks, docs, self.n_ids = np.frombuffer(data[-32:-8], "<u8").astype(int).tolist()
        self.data = np.frombuffer(data, np.uint8)
        at = len(data) - 32 - 17 * docs - 8 * blocks
        self.start = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at + 8 * blocks)
        self.null = np.frombuffer(data, np.uint8, docs, at + 8 * blocks + 8 * docs).astype(bool)
        self.counts = np.frombuffer(data, "<u8", docs, at + 8 * blocks + 9 * docs).astype(np.int64)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        return unpack_blocks(self.data, self.start[a:b])[start - a * BLOCK : stop - a * BLOCK]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, ids_per_file: int = 1 << 20) -> DataFrame:
    """Writes the files and returns their list: part, number, file, n_docs, n_ids, in ascending order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            name = f"ids-{part:06d}-{number:05d}.pfor"
            keys = [k for h in held for k in h[0]]
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            files.put(f"{folder}/{name}", to_file(keys, counts, ids))
            got = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "file": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]}, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            number += 1
            held.clear()
            return got

        for batch in batches:
            for rows, buf, offs in pieces(batch, "t"):
                ids, n = enc.texts(buf, offs)
                full = np.full(len(ids) + len(n), end_id, np.uint32)
                body = np.ones(len(full), bool)
                body[np.cumsum(n + 1) - 1] = False
                full[body] = ids
                held.append((rows.column(0).to_pylist(), n + 1, full))
                if sum(len(h[2]) for h in held) >= ids_per_file:
                    yield flush()
        if held:
            yield flush()

    # Rows of one id, or of none, are spread over ranges by their text's hash and length.
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = src.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "t")
    return write_and_read(ordered.mapInArrow(run, "part int, number int, file string, n_docs bigint, n_ids bigint"), "id-files")


def read_documents(listing: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""
    spark = listing.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                f = IdFile(data.as_py())
                ids = f.ids().astype("<u4")
                ends = np.cumsum(f.counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - f.counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(crc), pa.string()), pa.array(f.doc_ids, mask=f.null), pa.array(ends - f.counts), pa.array(f.counts), pa.array(crc, pa.int64())], ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    if listing.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = raw.mapInArrow(run, "file string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    starts = stream_starts(listing, ["part", "number"], "n_ids").select("file", F.col("start").alias("file_start"))
    return docs.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "token-ids")
