"""Numpy helpers for ragged byte texts inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts of about so many bytes are worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Ranges of more bytes are digested one by one.
LONG = 512
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_START = np.uint64(0x9E3779B97F4A7C15)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows one after another, row offsets); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose texts hold about ``size`` bytes: (rows, bytes, offsets)."""
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit names of byte ranges: eight bytes after another are mixed into a state that begins with the length."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        wide = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal for equal bytes, wherever they stand."""
        size = stop - start
        out = mix(_START + size.astype(np.uint64))
        left = np.arange(len(size)) if not len(size) or size.max() <= LONG else np.flatnonzero(size <= LONG)
        done = 0
        while True:
            left = left[size[left] > done] if done or len(left) and size.min() <= 0 else left
            if not len(left):
                break
            out[left] = mix(out[left] ^ (self.eight[start[left] + done] & _MASK[np.minimum(size[left] - done, 8)]))
            done += 8
        if len(size) and size.max() > LONG:
            for i in np.flatnonzero(size > LONG).tolist():
                out[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def windows(self, size: int) -> np.ndarray:
        """Name of the ``size`` bytes, a multiple of eight, from each position that has so many."""
        n = max(len(self.eight) - size, 0)
        out = np.full(n, mix(_START + np.uint64(size)))
        for done in range(0, size, 8):
            out = mix(out ^ self.eight[done : done + n])
        return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, words before each row) of runs of bytes other than ASCII white space."""
    ink = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first = ink & edge[:-1]
    first[1:] |= ink[1:] & ~ink[:-1]
    last = ink & edge[1:]
    last[:-1] |= ink[:-1] & ~ink[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offs)


def owner(bounds: np.ndarray) -> np.ndarray:
    """Row of each item, from the items before each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of keys that occur twice or more, mask of those that are not the first)."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
