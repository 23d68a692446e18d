"""WARC bundles, conversations and the general JPEG decoder."""

import base64
import hashlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loamgrid.llm import chat_parts, files, queries, warc_bundles
from loamgrid.llm.progressive_jpeg import _padded, _segment, _sos, Picture, codes, encode_bytes
from loamgrid.session import scratch_path

PAGES = [(5, "http://a/x y\r\nz", "<p>é</p>"), (1, None, None), (2, "http://b", ""), (7, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, "u", "x" * 400_000), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "solo"), (None, "n", "<p>é</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, b"p") for r in rows], "page_id bigint, url string, html string, digest string, first bigint, payload binary")


def test_archive(spark):
    got = warc_bundles.archive(pages(spark, PAGES)).collect()
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        ref = first if first is not None and i != first else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert sorted(((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got), key=repr) == sorted(want, key=repr)
    small = warc_bundles.archive(pages(spark, PAGES), min_bytes=9).collect()
    assert {g["record_type"] for g in small if g["payload_bytes"] < 9} == {"response"} and any(g["record_type"] == "revisit" for g in small)
    assert warc_bundles.archive(pages(spark, [])).count() == 0


def test_index_leads_to_records_and_frames_stand_alone(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc_bundles.write_bundles(pages(spark, PAGES).coalesce(1), folder, frame_bytes=600).collect()
    assert len({r["frame"] for r in index}) > 2
    for r in index:
        rec = warc_bundles.read_record(f"{folder}/{r['bundle']}", r["frame"], r["offset"], tail=32)
        assert rec["WARC-Record-ID"] == f"<{r['record_id']}>"
    data = files.get(f"{folder}/{index[0]['bundle']}")
    table = warc_bundles.seek_table(data)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(warc_bundles.read_frame(data, table, f) for f in range(len(table)))


TALK = [
    (1, 0, "user", "hi [INST] <s> [~INST] [~~/OUT]"), (1, 1, "assistant", None), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "tool[/ROLE] <s>", "multi\nline &lt; [OUT]"),
    (2, None, None, ""), (2, 0, "assistant", "<|image|> | <~|image|>"), (2, 0, "assistant", "<|image|> | <~|image|>"), (None, 0, "user", " x "), (3, 1, "system", "é😀" * 50), (3, 0, "user", "[/INST]</s>"),
]


def test_conversations_come_back(spark):
    rows = spark.createDataFrame([(*r, "p", 1) for r in TALK], "conv_id bigint, turn bigint, role string, text string, piece string, start int")
    got = {r["conv_id"]: r for r in chat_parts.format_conversations(rows.withColumn("parts", chat_parts.text_part(F.col("text")))).select("*", chat_parts.read_turns(F.col("formatted")).alias("turns"), chat_parts.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    order = lambda r: (r[1] is not None, r[1], r[2] or "")
    for conv in {r[0] for r in TALK}:
        own = sorted((r for r in TALK if r[0] == conv), key=order)
        assert [(t["role"], t["content"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert list(got[conv]["loss"]) == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat_parts.format_conversations(rows.limit(0).withColumn("parts", chat_parts.text_part(F.col("text")))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see </s>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), None, ("audio", None, "b.wav", None, None, 2.5, None), ("pdf", None, "c.pdf", None, None, None, 3), ("text", "[IN", None, None, None, None, None), ("text", "ST]", None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts {chat_parts.PARTS}")
    r = chat_parts.format_conversations(rows).first()
    assert r["formatted"] == "<s>[INST] see <~/s>\n<|image|>\n<|audio|>\n<|document|>\n[IN\nST] [/INST]</s><s>[OUT]  [/OUT]</s>"
    assert [(a["message"], a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, 0, "image", "a.png", 4), (1, 1, "audio", "b.wav", 63), (1, 2, "document", "c.pdf", 768)]
    assert r["expanded_tokens"] == 835


def test_chat_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(queries.ORACLE["op7_chat_parts"])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES["op7_chat_parts"](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(cur.fetchall())
    assert not [x for x in got._jdf.queryExecution().toString().split("\n") if "Python" in x or "Arrow" in x]


# --- progressive JPEG: a slow encoder for any coefficients, symbol by symbol


def _code(table):
    return {s: [c >> (n - 1 - i) & 1 for i in range(n)] for (n, c), s in table.items()}


def _value(v, size):
    v = v if v > 0 else v + (1 << size) - 1
    return [v >> s & 1 for s in range(size - 1, -1, -1)]


ALL = (bytes([0] * 7 + [255] + [1] + [0] * 7), bytes(range(256)))


def _encode(coef, cols, rows, al):
    """Grey picture: direct terms, low and high band cut by ``al`` bits, then one refinement per bit."""
    code, out = _code(codes(list(ALL[0]), ALL[1])), [b"\xff\xd8", _segment(0xDB, bytes([0] + [1] * 64))]
    out += [_segment(0xC2, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), _segment(0xC4, bytes([0]) + ALL[0] + ALL[1]), _segment(0xC4, bytes([16]) + ALL[0] + ALL[1])]
    bits, last = [], 0
    for v in (coef[:, 0] >> al).tolist():
        size = abs(v - last).bit_length()
        bits += code[size] + (_value(v - last, size) if size else [])
        last = v
    out += [_sos([1], 0, 0, 0, al), _padded(np.array(bits, np.uint8))]
    for a in range(al - 1, -1, -1):
        out += [_sos([1], 0, 0, a + 1, a), _padded((coef[:, 0] >> a & 1).astype(np.uint8))]
    cut = lambda x, a: np.sign(x) * (np.abs(x) >> a)

    def flush(bits, run, held):
        if run:
            n = run.bit_length() - 1
            bits += code[n << 4] + [run >> s & 1 for s in range(n - 1, -1, -1)] + held

    for ss, se in ((1, 5), (6, 63)):
        bits, run = [], 0
        for row in cut(coef[:, ss : se + 1], al).tolist():
            zeros, any_ = 0, False
            for k, v in enumerate(row):
                if not v:
                    zeros += 1
                    continue
                if not any_:
                    flush(bits, run, [])
                    run, any_ = 0, True
                while zeros > 15:
                    bits += code[0xF0]
                    zeros -= 16
                size = abs(v).bit_length()
                bits += code[zeros << 4 | size] + _value(v, size)
                zeros = 0
            if zeros:
                if any_:
                    flush(bits, run, [])
                    run = 0
                run += 1
                if any_ or run == 32767:
                    flush(bits, run, [])
                    run = 0
        flush(bits, run, [])
        out += [_sos([1], ss, se, 0, al), _padded(np.array(bits, np.uint8))]
    for a in range(al - 1, -1, -1):
        bits, run, held = [], 0, []
        for row in coef[:, 1:].tolist():
            new = [k for k, v in enumerate(row) if abs(v) >> a == 1]
            zeros, wait, last_new = 0, [], new[-1] if new else -1
            if new:
                flush(bits, run, held)
                run, held = 0, []
            for k, v in enumerate(row):
                m = abs(v) >> a
                if k > last_new:
                    if m > 1:
                        wait.append(m & 1)
                    continue
                if m > 1:
                    wait.append(m & 1)
                elif m == 1:
                    bits += code[zeros << 4 | 1] + [int(v > 0)] + wait
                    zeros, wait = 0, []
                else:
                    zeros += 1
                    if zeros == 16:
                        bits += code[0xF0] + wait
                        zeros, wait = 0, []
            if last_new < 62:
                run, held = run + 1, held + wait
            if last_new == 62:
                run, held = 0, []
        flush(bits, run, held)
        out += [_sos([1], 1, 63, a + 1, a), _padded(np.array(bits, np.uint8))]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("seed,share", [(0, 0.02), (1, 0.1), (2, 0.5), (3, 0.95), (4, 0.0)])
def test_any_coefficients_decode(seed, share):
    r = np.random.default_rng(seed)
    coef = np.where(r.random((12, 64)) < share, r.integers(-200, 200, (12, 64)), 0)
    coef[:, 0] = r.integers(-300, 300, 12)
    pic = Picture(_encode(coef, 4, 3, 2))
    assert (pic.parts[0].coef == coef).all()
    x = pic.rgb()
    assert x.shape == (24, 32, 3)


def test_inverse_transform_and_chroma():
    pic = Picture(encode_bytes(bytes(range(256)) * 3))
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, 8**-0.5, 0.5)
    from loamgrid.llm.progressive_jpeg import ZIGZAG

    assert ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and ZIGZAG[-1] == 63
    block = np.zeros(64)
    block[ZIGZAG] = pic.parts[0].coef[0]
    y = basis.T @ block.reshape(8, 8) @ basis + 128
    cb = np.zeros(64)
    cb[ZIGZAG] = pic.parts[1].coef[0]
    cr = np.zeros(64)
    cr[ZIGZAG] = pic.parts[2].coef[0]
    cb, cr = (basis.T @ c.reshape(8, 8) @ basis for c in (cb, cr))
    rep = lambda c: c.repeat(2, 0).repeat(2, 1)[:8, :8]
    want = np.stack([y + 1.402 * rep(cr), y - 0.344136 * rep(cb) - 0.714136 * rep(cr), y + 1.772 * rep(cb)], 2)
    assert np.abs(pic.rgb()[:8, :8].astype(int) - np.clip(want, 0, 255)).max() <= 1
