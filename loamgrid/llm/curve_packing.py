"""Sequence packing along a space-filling curve.

Every document becomes a hashed token-count vector, which a fixed random projection takes to four dimensions; the
Hilbert index of the quantised point orders documents so that like texts stand side by side. In that order the token
streams are laid end to end and cut every ``length`` tokens, so only the very last sequence can need padding.

The order is made on rows of a few numbers; token ids are moved once. Equal keys are split by document id, so a group
of copies with a third of all rows still spreads over the range partitions. A document's tokens travel as one value.

Defined cases: null text is empty and contributes the end id alone; repeated rows are packed each; equal keys are
ordered by document id, then row; a null document id comes first; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.arrays import pieces
from loamgrid.llm.tokens import encoder
from loamgrid.session import scratch_path, write_and_read

HASHED, DIMS, BITS = 64, 4, 15


def projection(hashed: int = HASHED, dims: int = DIMS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).standard_normal((hashed, dims))


def curve_points(ids: np.ndarray, counts: np.ndarray, hashed: int = HASHED, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Grid point of each document: hashed counts, scaled to length 1, projected, spread evenly over the grid."""
    n = len(counts)
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    cell = np.repeat(np.arange(n) * hashed, counts) + (h & np.uint64(hashed - 1)).astype(np.int64)
    sign = np.where(h & np.uint64(hashed), 1.0, -1.0)
    v = np.bincount(cell, weights=sign, minlength=n * hashed).reshape(n, hashed)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    z = np.round(v @ projection(hashed, dims), 9)
    even = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # close to the normal distribution function
    return np.minimum(even * (1 << bits), (1 << bits) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each grid point (Skilling's transpose form, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, curve_key, n_tokens, ids (little-endian, ``width`` bytes each) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for rows, buf, offs in pieces(batch, "t"):
                ids, n = enc.texts(buf, offs)
                key = hilbert(curve_points(ids, n))
                all_ids = np.full(len(ids) + len(n), end_id, np.uint16 if width == 2 else np.uint32)
                ends = np.cumsum(n + 1)
                body = np.ones(len(all_ids), bool)
                body[ends - 1] = False
                all_ids[body] = ids
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]) * width), pa.py_buffer(all_ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(key), pa.array(n + 1), packed.cast(pa.binary()), pa.array(np.full(len(n), width, np.int32))], ["doc_id", "curve_key", "n_tokens", "ids", "width"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, curve_key bigint, n_tokens bigint, ids binary, width int")


def stream_starts(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """``rows`` with ``start``: the sum of ``amount`` over all rows before, in the given order, which must be unique.

    Rows are range-partitioned, sums of whole partitions are added up, and the rest is a window inside a partition.
    """
    parts = write_and_read(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    totals = parts.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    before = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(before, "__part").withColumn("start", F.col("__before") + F.coalesce(F.sum(amount).over(w), F.lit(0))).drop("__before", "__part")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start and length in the document, doc_tokens, sequence_id, offset, ids (unsigned
    32-bit little-endian) and their ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    # Rows get a number that stays, so repeated document ids do no harm.
    tokenised(docs, tokenizer, id_col, text, end_id).withColumn("row_id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    placed = stream_starts(tokens.select("row_id", "doc_id", "curve_key", "n_tokens"), ["curve_key", "doc_id", "row_id"], "n_tokens").select("row_id", "start")
    return tokens.select("row_id", "doc_id", "n_tokens", "ids", "width").join(placed, "row_id").select("doc_id", "n_tokens", "ids", "width", "start").mapInArrow(
        lambda batches: cut_stream(batches, length), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint, ids binary"
    )


def cut_stream(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]
    for batch in batches:
        for rows, buf, offs in pieces(batch, "ids"):
            n, at = rows.column(1).to_numpy(), rows.column(4).to_numpy()
            first, last = at // length, (at + n - 1) // length
            per = last - first + 1
            doc = np.repeat(np.arange(len(n)), per)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
            begin = np.maximum(at[doc], seq * length)
            size = np.minimum((at + n)[doc], (seq + 1) * length) - begin
            start = begin - at[doc]
            width = rows.column(3).to_numpy()
            out = []
            for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist()):
                w, o = width[d], offs[d]
                out.append(buf[o + s * w : o + (s + k) * w].view(np.uint16 if w == 2 else np.uint32).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(n[doc]), pa.array(seq), pa.array(begin - seq * length), pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names
            )
