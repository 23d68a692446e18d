"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends with a seek table in a skippable frame
(the published seekable format), so any frame can be found from the end of the file; the index returned by the writer
maps each record identifier to bundle, frame and the offset inside the decompressed frame.

Of records with equal payloads of ``min_bytes`` or more the one with the smallest page id is a response, the others
are revisits that refer to it and carry no payload. Which digests repeat is found by a grouped minimum, combined
map-side; a payload shared by a third of all rows is split by the adaptive skew join.

Defined cases: null html is an empty payload; rows with equal page id and payload are all responses when that id is
the smallest; null page ids never become the referred one unless all are null, then all are responses; white space
and control characters in addresses are percent-encoded; an empty table gives no bundle and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import files
from loamgrid.session import scratch_path, write_and_read

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame int, offset bigint"


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page(uri: str) -> int | None:
    got = uri.strip("<>").rpartition(":")[2]
    return int(got) if got else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-Full-Payload-Length: {len(payload)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the decompressed frame)."""
        if self.open and self.open_size + len(record) > self.frame_bytes:
            self.close_frame()
        at = (len(self.frames), self.open_size)
        self.open.append(record)
        self.open_size += len(record)
        return at

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            data = self.zstd.compress(raw)
            self.frames.append((data, len(raw)))
            self.size += len(data)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(d), n) for d, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(d for d, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(tail: bytes) -> np.ndarray:
    """(start, compressed size, raw size) of each frame, from the last bytes of a bundle."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    sizes = np.frombuffer(tail[len(tail) - 9 - entry * n : len(tail) - 9], "<u4").reshape(n, entry // 4)[:, :2].astype(np.int64)
    return np.column_stack([np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes])


def read_frame(data: bytes, table: np.ndarray, frame: int) -> bytes:
    start, size, raw = table[frame].tolist()
    return zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=raw)


def read_record(path: str, frame: int, offset: int, tail: int = 1 << 16) -> dict:
    """One record by its place, reading the seek table and one frame only."""
    from pyarrow import fs

    store, p = files._store(path)
    size = store.get_file_info(p).size
    end = files.get(path, max(0, size - tail))
    need = 9 + 8 * struct.unpack("<I", end[-9:-5])[0]
    if need > len(end):
        end = files.get(path, size - need)
    start, length, raw = seek_table(end)[frame].tolist()
    return parse_record(zstandard.ZstdDecompressor().decompress(files.get(path, start, length), max_output_size=raw), offset)[0]


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """(headers and payload of the record at an offset, offset of the next)."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    return head | {"payload": block[block.index(b"\r\n\r\n") + 4 :]}, end + 8 + len(block)


def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload and ``refers_to`` (null for responses)."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= min_bytes
    firsts = src.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(big & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return src.join(firsts, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, **columns: str) -> DataFrame:
    """Writes all pages and returns the index of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, rows = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes), []

        def flush() -> pa.RecordBatch:
            nonlocal number, out, rows
            name = f"pages-{part:06d}-{number:05d}.warc.zst"
            files.put(f"{folder}/{name}", out.finish())
            cols = list(zip(*((record_uri(p), p, name, f, o, n) for p, f, o, n in rows)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])
            number, out, rows = number + 1, BundleWriter(frame_bytes), []
            return got

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                page, refers = page.as_py(), refers.as_py()
                record = build_record(page, url.as_py(), payload.as_py(), refers, refers is not None)
                frame, offset = out.add(record)
                rows.append((page, frame, offset, len(record)))
                if out.size >= bundle_bytes:
                    yield flush()
        if rows:
            yield flush()

    return write_and_read(with_roles(pages, min_bytes, **columns).mapInArrow(run, INDEX), "warc-index")


def read_bundles(spark, folder: str) -> DataFrame:
    """Every record of all bundles; digests of responses are computed from the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data, name = content.as_py(), path.as_py().rpartition("/")[2]
                table = seek_table(data)
                for frame in range(len(table)):
                    raw, at, rows = read_frame(data, table, frame), 0, []
                    while at < len(raw):
                        rec, nxt = parse_record(raw, at)
                        page = _page(rec["WARC-Record-ID"])
                        if rec["WARC-Type"] == "revisit":
                            rows.append((page, int(rec["WARC-Full-Payload-Length"]), rec["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", _page(rec["WARC-Refers-To"]), name, frame, at))
                        else:
                            rows.append((page, len(rec["payload"]), sha1_base32(rec["payload"]), "response", None, name, frame, at))
                        at = nxt
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return raw.select("path", "content").mapInArrow(run, READ)


def archive(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes the archives into the shared folder and reads them back; a bundle not in the index is not read."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    index = write_bundles(pages, folder, min_bytes, **columns)
    if index.isEmpty():
        return spark.createDataFrame([], READ)
    return read_bundles(spark, folder).join(index.select("bundle").distinct(), "bundle", "left_semi")
