"""Media columns of progressive JPEG files.

``decode`` reads any 8-bit Huffman-coded progressive file of one or three components: spectral-selection and
successive-approximation scans are accumulated into coefficient arrays, then dequantised, inverse-transformed with
numpy, chroma is brought to full resolution and RGB comes out as one tensor.

``encode_bytes`` stores a byte payload as a picture without loss. The format's lossless unit is the quantised
coefficient: byte ``b`` becomes coefficient ``256 + b`` at its place in zigzag order, 64 bytes to a block, four blocks
of luma to one of each chroma. Direct terms come in two scans, the rest in two spectral bands and two refinements.

``features`` stores the tensors as a column and computes features from what it reads back. Tensors are larger than the
pictures (two bytes for each byte of payload before compression), so they are stored for a slice of the files at a time.

Symbols are decoded one by one, but for two kinds of stretch that numpy reads at once: scans that consist of one
symbol throughout, and correction bits inside end-of-band runs. Any file may hold them; stored payloads are made of them.

Defined cases: null text is an empty payload, which is padded to 64 zeros like any other; equal texts give equal files;
repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.arrays import pieces
from loamgrid.llm.tables import release, settle, slices


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag index: along the diagonals in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Rows are frequencies of the orthonormal cosine transform.
COSINES = (np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


# --- Huffman tables and bits


def codes(lengths: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, from the counts of codes of length 1 to 16."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return out


class Bits:
    """Bits of an entropy-coded stretch, most significant first; beyond the end there are ones."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        got = 0
        for b in self.bits[self.at : self.at + n].tolist():
            got = got * 2 + b
        short = self.at + n - len(self.bits)
        self.at += n
        return got if short <= 0 else (got + 1 << min(short, n)) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n, b in enumerate(self.bits[self.at : self.at + 16].tolist(), 1):
            code = code * 2 + b
            if (n, code) in table:
                self.at += n
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


# --- scans


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def place(self, width: int, height: int, hmax: int, vmax: int) -> None:
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.cols, self.rows = across * self.h, down * self.v
        own = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        #: Blocks in the order of scans of this component alone, and by unit of scans of all.
        self.alone = (np.arange(own[1])[:, None] * self.cols + np.arange(own[0])).ravel()
        grid = np.arange(self.rows * self.cols).reshape(down, self.v, across, self.h)
        self.units = grid.transpose(0, 2, 1, 3).reshape(across * down, self.h * self.v)
        self.coef = np.zeros((self.rows * self.cols, 64), np.int32)


def _direct_first(bits: Bits, order: list[tuple[Component, int, dict]], al: int) -> None:
    last: dict[int, int] = {}
    for comp, block, table in order:
        size = bits.symbol(table)
        last[comp.ident] = last.get(comp.ident, 0) + (bits.signed(size) if size else 0)
        comp.coef[block, 0] = last[comp.ident] << al


def _direct_more(bits: Bits, order: list[tuple[Component, int, dict]], al: int) -> None:
    got = bits.bits[bits.at : bits.at + len(order)]
    bits.at += len(order)
    for (comp, block, _), b in zip(order, got.tolist()):
        comp.coef[block, 0] |= b << al


def _one_symbol(data: bytes, table: dict[tuple[int, int], int], count: int) -> np.ndarray | None:
    """Values of a scan in which each coefficient is the same symbol without zeros before it, if it is one."""
    for (n, code), sym in table.items():
        size = sym & 15
        if sym >> 4 or not size or len(data) < count * (n + size) // 8:
            continue
        if n + size == 8 and b"\xff" not in data and len(data) == count:
            x = np.frombuffer(data, np.uint8)
            if not (x >> size != code).any():
                v = (x & (1 << size) - 1).astype(np.int32)
                return np.where(v >> (size - 1), v, v - (1 << size) + 1)
            continue
        flat = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        if not 0 <= len(flat) - count * (n + size) < 8:
            continue
        x = flat[: count * (n + size)].reshape(count, n + size)
        if (x[:, :n] == [code >> (n - 1 - i) & 1 for i in range(n)]).all():
            v = x[:, n:].astype(np.int32) @ (1 << np.arange(size)[::-1]).astype(np.int32)
            return np.where(v >> (size - 1), v, v - (1 << size) + 1)
    return None


def _band_first(data: bytes, comp: Component, blocks: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
    got = _one_symbol(data, table, len(blocks) * (se - ss + 1))
    if got is not None:
        comp.coef[blocks, ss : se + 1] = (got << al).reshape(len(blocks), -1)
        return
    bits, run = Bits(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            sym = bits.symbol(table)
            zeros, size = sym >> 4, sym & 15
            if size:
                k += zeros
                comp.coef[b, k] = bits.signed(size) << al
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _correct(bits: Bits, comp: Component, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
    """Correction bits of all coefficients so far in whole blocks."""
    part = comp.coef[blocks, ss : se + 1]
    old = part != 0
    n = int(old.sum())
    if n == old.size:
        part += np.sign(part) * (bits.bits[bits.at : bits.at + n].reshape(part.shape).astype(np.int32) << al)
    else:
        part[old] += np.sign(part[old]) * (bits.bits[bits.at : bits.at + n].astype(np.int32) << al)
    bits.at += n
    comp.coef[blocks, ss : se + 1] = part


def _band_more(data: bytes, comp: Component, blocks: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
    bits, at = Bits(data), 0
    while at < len(blocks):
        row, k = comp.coef[blocks[at]], ss
        while k <= se:
            sym = bits.symbol(table)
            zeros, size = sym >> 4, sym & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                if k > ss:  # the rest of this block, then whole blocks
                    _correct(bits, comp, blocks[at : at + 1], k, se, al)
                    at, run = at + 1, run - 1
                _correct(bits, comp, blocks[at : at + run], ss, se, al)
                at += run
                break
            new = (1 if bits.take(1) else -1) << al if size else 0
            while k <= se:
                if row[k]:
                    row[k] += np.sign(row[k]) * (bits.take(1) << al)
                elif zeros:
                    zeros -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        else:
            at += 1


class Picture:
    """Coefficients of a progressive file and what they show."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.parts: list[Component] = []
        self.note = b""
        huff: dict[int, dict] = {}
        every = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            mark = data[at + 1]
            if mark == 0xD9:
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                    body = body[129 if wide else 65 :]
            elif mark == 0xC4:
                while body:
                    lengths = list(body[1:17])
                    huff[body[0]] = codes(lengths, body[17 : 17 + sum(lengths)])
                    body = body[17 + sum(lengths) :]
            elif mark == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                for c in self.parts:
                    c.place(self.width, self.height, max(x.h for x in self.parts), max(x.v for x in self.parts))
            elif 0xC0 <= mark <= 0xCF and mark != 0xC8:
                raise ValueError("not a progressive Huffman-coded file")
            elif mark == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif mark == 0xFE:
                self.note = body
            elif mark == 0xDA:
                end = _MARKER.search(data, at).start()
                self.scan(body, data[at:end], huff, every)
                at = end

    def scan(self, head: bytes, data: bytes, huff: dict[int, dict], every: int) -> None:
        n = head[0]
        chosen = [(next(c for c in self.parts if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        units = len(chosen[0][0].alone if n == 1 else chosen[0][0].units)
        stretches = _RESTART.split(data) if every else [data]
        for i, part in enumerate(stretches):
            lo, hi = (i * every, min(units, (i + 1) * every)) if every else (0, units)
            if ss:
                comp, t = chosen[0]
                (_band_more if ah else _band_first)(part, comp, comp.alone[lo:hi], huff[16 | t & 15], ss, se, al)
                continue
            tables = [huff.get(t >> 4, {}) for _, t in chosen]
            if n == 1:
                order = [(chosen[0][0], b, tables[0]) for b in chosen[0][0].alone[lo:hi].tolist()]
            else:
                cols = [c.units[lo:hi].tolist() for c, _ in chosen]
                order = [(c, b, t) for unit in zip(*cols) for (c, _), bs, t in zip(chosen, unit, tables) for b in bs]
            (_direct_more if ah else _direct_first)(Bits(part), order, al)

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor (height, width, 3) of bytes."""
        planes = []
        hmax, vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        for c in self.parts:
            x = np.empty((len(c.coef), 64), np.float32)
            x[:, ZIGZAG] = c.coef * self.quant[c.table]
            x = (x.reshape(-1, 8) @ COSINES).reshape(-1, 8, 8)  # along rows
            x = np.matmul(COSINES.T, x)
            x = x.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
            if c.v < vmax or c.h < hmax:
                x = x.repeat(vmax // c.v, 0).repeat(hmax // c.h, 1)
            planes.append(x[: self.height, : self.width])
        y = planes[0] + 128
        if len(planes) == 1:
            out = np.stack([y, y, y], 2)
        else:
            cb, cr = planes[1], planes[2]
            out = np.empty((*y.shape, 3), np.float32)
            out[..., 0] = y + 1.402 * cr
            out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
            out[..., 2] = y + 1.772 * cb
        return np.clip(np.rint(out, out=out), 0, 255).astype(np.uint8)


# --- payloads as pictures

UNIT = 6 * 64
#: 4-bit codes for sizes 0 to 11 of direct terms; one bit for size 7 and 5-bit codes for all end-of-band runs otherwise.
_DC = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
_AC = (bytes([1, 0, 0, 0, 15] + [0] * 11), bytes([7, *(n << 4 for n in range(15))]))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _sos(parts: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), ss, se, ah << 4 | al]))


def _padded(bits: np.ndarray) -> bytes:
    short = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(short, np.uint8)]) if short else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _direct_bits(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Codes of the differences of direct terms; ``of`` names the component of each."""
    diff = values.copy()
    for c in range(3):
        at = np.flatnonzero(of == c)
        diff[at[1:]] -= values[at[:-1]]
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    word = size << size | np.where(diff < 0, diff + (1 << size) - 1, diff)
    n = size + 4
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.repeat(word, n) >> (np.repeat(n, n) - 1 - step) & 1).astype(np.uint8)


def encode_bytes(payload: bytes, note: bytes = b"") -> bytes:
    """A progressive file whose coefficients hold the payload, a positive multiple of 64 bytes."""
    units = -(-len(payload) // UNIT)
    down = -(-units // 4095)
    across = -(-units // down)
    units = across * down
    b = np.zeros(units * UNIT, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = b.reshape(-1, 64)
    parts = [b[: 4 * units], b[4 * units : 5 * units], b[5 * units :]]
    head = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)) + note), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, head)]
    out += [_segment(0xC4, bytes([0]) + _DC[0] + _DC[1]), _segment(0xC4, bytes([16]) + _AC[0] + _AC[1])]
    luma = np.arange(4 * units).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    direct = np.column_stack([parts[0][luma, 0], parts[1][:, 0], parts[2][:, 0]]).ravel().astype(np.int64)
    out += [_sos([1, 2, 3], 0, 0, 0, 1), _padded(_direct_bits(direct + 256 >> 1, np.tile([0, 0, 0, 0, 1, 2], units)))]
    for c, x in enumerate(parts, 1):
        first = x >> 2 | 0x40  # code 0, then the seven bits of a size-7 value
        out += [_sos([c], 1, 5, 0, 2), first[:, 1:6].tobytes(), _sos([c], 6, 63, 0, 2), first[:, 6:].tobytes()]
    for al in (1, 0):
        if not al:
            out += [_sos([1, 2, 3], 0, 0, 1, 0), _padded((direct & 1).astype(np.uint8))]
        for c, x in enumerate(parts, 1):
            bits = []
            for at in range(0, len(x), 32767):
                run = len(x[at : at + 32767])
                n = run.bit_length() - 1
                code = [1, *(n >> s & 1 for s in (3, 2, 1, 0))]
                bits += [np.array(code + [run >> s & 1 for s in range(n - 1, -1, -1)], np.uint8), (x[at : at + 32767, 1:] >> al & 1).ravel()]
            out += [_sos([c], 1, 63, al + 1, al), _padded(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(pic: Picture) -> bytes:
    """The bytes that ``encode_bytes`` stored."""
    size = struct.unpack(">Q", pic.note[:8])[0]
    return np.concatenate([c.coef for c in pic.parts]).astype(np.int16).ravel()[:size].__sub__(256).astype(np.uint8).tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def feature(rgb: np.ndarray) -> str:
    mean = rgb.reshape(-1, 3).mean(0, dtype=np.float64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]:.2f},{mean[1]:.2f},{mean[2]:.2f}"


# --- media columns

#: Slices whose tensors are stored one after another, and rows of a stored file, of which slices are made.
SLICES, FILE_ROWS = 16, 1 << 11
_DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
_DIGEST_SQL = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, written to the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in pieces(batch, "t"):
                media = [encode_bytes(padded(bytes(buf[a:b]))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    return settle(src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary"), "media", file_rows=FILE_ROWS)


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """Every picture as ``height``, ``width`` and ``rgb`` (bytes of the full-resolution tensor) beside the other columns, with
    digests of the payload that it holds and of its file."""
    keep = [c for c in media.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), **_DIGESTS}
        for batch in batches:
            for rows, buf, offs in pieces(batch, column):
                out = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    data = bytes(buf[a:b])
                    pic = Picture(data)
                    back, x = payload_of(pic), pic.rgb()
                    out.append((x.shape[0], x.shape[1], x.tobytes(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(zip(*out), kinds.values()))], [*keep, *kinds])

    return media.select(*keep, column).mapInArrow(run, f"{_types(media, keep)}, height int, width int, rgb binary, {_DIGEST_SQL}")


def means(pictures: DataFrame) -> DataFrame:
    """The feature of every stored tensor in its place, beside the other columns."""
    keep = [c for c in pictures.columns if c not in ("height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb"))
            found = [feature(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) for h, w, x in sizes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], [*keep, "feature"])

    return pictures.mapInArrow(run, f"{_types(pictures, keep)}, feature string")


def features(media: DataFrame) -> DataFrame:
    """What is read back from each stored picture, and a feature of its stored tensor.

    The tensors of a slice are written, read back and deleted before the next slice.
    """
    out = []
    for part in slices(media, SLICES):
        pictures = settle(tensors(part), "tensors")
        out.append(settle(means(pictures), "features"))
        release(pictures)
    return reduce(DataFrame.unionByName, out)
