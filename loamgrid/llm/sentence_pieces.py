"""SentencePiece encoding and decoding by suffix-array matching.

New words of a batch are concatenated and indexed by a suffix array, built by prefix doubling on 8-byte keys as deep as
the longest piece. Every piece of the vocabulary is binary-searched for the range of suffixes that begin with it; the
ranges give all occurrences as edges. Edges are sorted by position and relaxed from left to right.

The model file holds byte-pair pieces, whose merges are not a best path by score. But a sequence of pieces is the
merge result exactly if every two neighbours are the merge result of their own concatenation, and each prefix of a
text has one such sequence. So a position is relaxed by the one edge whose piece stands with the last piece before it;
whether a pair stands is found by taking both pieces back through their merges, all pairs of a step together, and the
answers are kept in a table of fixed size. Results equal the library's.

Words are cut where a blank follows something else, which no piece crosses; ids of frequent words are remembered in
each Python worker up to a bound. Characters without a piece become byte pieces. ``round_trip`` encodes, decodes and
digests a piece of text in one Arrow step, so that a core holds one Python worker.

Defined cases: null and empty texts have no ids; decoding returns the text, whatever its blanks and line feeds
(a literal blank mark U+2581 comes back as a blank, as in the library); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.arrays import gather, mix
from loamgrid.llm.arrays import pieces as text_pieces
from loamgrid.llm.tokens import REMEMBER, WordEncoder, WordTable

BLANK = "▁"
#: Places for answers on pairs of pieces in a worker; a new answer takes the place of an old one.
PAIRS = 1 << 20


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` bytes, the first 8 bytes of each position as a number)."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : n + i]
    words8, size = key, 8
    while True:
        order = np.argsort(key, kind="stable")
        if size >= depth:
            return order, words8
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: max(n - size, 0)] = rank[size:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        size *= 2


class PieceTable:
    """The pieces of a model that text is made of."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(BLANK in p.lstrip(BLANK) for p in self.text.values()):
            raise ValueError("pieces that cross words are not supported")
        self._merges({i: -sp.get_score(i) for i in normal}, n)
        data = [self.text[i].encode() for i in normal]
        self.ids = np.array(normal, np.int64)
        self.size = np.array([len(d) for d in data], np.int64)
        self.depth = int(self.size.max())
        width = -(-self.depth // 8) * 8
        low = np.array([np.frombuffer(d.ljust(width, b"\0"), ">u8") for d in data], np.uint64)
        high = np.array([np.frombuffer(d.ljust(width, b"\xff"), ">u8") for d in data], np.uint64)
        self.low, self.high = low, high

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece) of every occurrence of every piece."""
        order, words8 = suffix_array(text, self.depth)
        first = words8[order]
        lo, hi = np.searchsorted(first, self.low[:, 0], "left"), np.searchsorted(first, self.high[:, 0], "right")
        padded = np.concatenate([words8, np.zeros(self.depth + 8, np.uint64)])
        for part in range(1, self.low.shape[1]):
            at = np.flatnonzero((self.size > 8 * part) & (lo < hi))
            for key, side in ((self.low[at, part], "left"), (self.high[at, part], "right")):
                a, b = lo[at].copy(), hi[at].copy()
                while (a < b).any():
                    mid = np.minimum((a + b) >> 1, len(order) - 1)
                    x = padded[order[mid] + 8 * part]
                    right = (x < key if side == "left" else x <= key) & (a < b)
                    b = np.where(right | (a >= b), b, mid)
                    a = np.where(right, mid + 1, a)
                if side == "left":
                    left = a
                else:
                    lo[at], hi[at] = left, a
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        start = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(which))]
        return start, start + self.size[which], self.ids[which]

    def _merges(self, cost: dict[int, float], n: int) -> None:
        """Which pieces two pieces join to, what each costs (the cheapest is merged first) and its two last parts."""
        number = {t: i for i, t in self.text.items()}
        for c in {c for t in self.text.values() for c in t} - number.keys():
            number[c] = n  # a character that is no piece of its own still starts merges
            n += 1
        self.cost, chars = np.full(n, -1.0), np.ones(n, np.int64)
        for t, i in number.items():
            if len(t) > 1:
                self.cost[i], chars[i] = cost[i], len(t)
        found = np.array([(number[t[:k]], number[t[k:]], i) for t, i in number.items() for k in range(1, len(t)) if t[:k] in number and t[k:] in number], np.int64).reshape(-1, 3)
        code = found[:, 0] << 20 | found[:, 1]
        order = np.argsort(code)
        self.codes, self.joins = np.append(code[order], np.int64(1) << 60), np.append(found[order, 2], -1)
        self.last = np.full((n, 2), -1)
        for size in range(2, int(chars.max(initial=1)) + 1):
            part = found[chars[found[:, 2]] == size]
            part = part[self.stand(part[:, 0], part[:, 1], joined=True)]
            self.last[part[:, 2]] = part[:, :2]

    def stand(self, x: np.ndarray, y: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether two pieces side by side are the merge result of their concatenation; with ``joined``, whether they
        are so just before they merge themselves.

        Goes back in time: the piece that was formed later is taken apart at the boundary, and a merge across the
        boundary that came before it (or at once, being further left) would have hindered it.
        """
        out, left = np.zeros(len(x), bool), np.arange(len(x))
        before, left_wins = np.full(len(x), np.inf), np.zeros(len(x), bool)
        while len(left):
            code = x << 20 | y
            at = np.searchsorted(self.codes, code)
            across = np.where(self.codes[at] == code, self.joins[at], -1)
            c = self.cost[across]
            stands = (across < 0) | ~((c < before) | left_wins & (c == before))
            if joined:
                stands, joined = np.ones(len(x), bool), False
            cx, cy = self.cost[x], self.cost[y]
            done = (cx < 0) & (cy < 0)
            out[left[stands & done]] = True
            first = cx > cy
            nx, ny = np.where(first, self.last[x, 1], x), np.where(first, y, self.last[y, 0])
            on = stands & ~done & (nx >= 0) & (ny >= 0)
            left, x, y, before, left_wins = left[on], nx[on], ny[on], np.maximum(cx, cy)[on], ~first[on]
        return out


class PieceEncoder(WordEncoder):
    """Exact ids of a byte-pair SentencePiece model with the identity normaliser and a leading blank."""

    def __init__(self, path: str, remember: int = REMEMBER):
        self.table = PieceTable(path)
        self.pieces, self.rule, self.lowers, self.added = self.table, "pieces", False, []
        self.remember, self.table = remember, WordTable()
        self.pairs, self.answers = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if BLANK.encode() in buf.tobytes():  # the model takes its blank mark for a blank
            data, ends = buf.tobytes(), offs.tolist()
            texts = [data[a:b].replace(BLANK.encode(), b" ") for a, b in zip(ends, ends[1:])]
            buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        size = np.diff(offs)
        extra = (size > 0).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(size + extra)])
        led = np.full(to[-1], 32, np.uint8)
        body = np.ones(len(led), bool)
        body[to[:-1][size > 0]] = False
        led[body] = buf
        return super().texts(led, to)

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank = buf == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(first)
        return start, np.concatenate([start[1:], [len(buf)]]) if len(start) else start, np.searchsorted(start, offs)

    def encode(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        table = self.pieces
        data = [w.replace(b" ", BLANK.encode()) for w in map(bytes, np.split(buf[gather(start, stop - start)], np.cumsum(stop - start)[:-1]))]
        size = np.array([len(d) for d in data], np.int64)
        begin = np.cumsum(size + 1) - size - 1  # one byte between words that no text has
        text = np.frombuffer(b"\xff".join(data) + b"\xff", np.uint8)
        start, stop, piece = table.occurrences(text)

        # Characters without a piece are edges of their own, which part what stands on either side.
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        chars = chars[text[chars] != 0xFF]
        width = _width(text, chars)
        whole = np.zeros(len(text) + 1, bool)
        whole[start[stop - start == _width(text, start)]] = True
        lone = ~whole[chars]
        start = np.concatenate([start, chars[lone]])
        stop = np.concatenate([stop, chars[lone] + width[lone]])
        piece = np.concatenate([piece, np.full(int(lone.sum()), -1)])

        # Edges by where they end inside their word, longer ones first; all words advance together.
        first = np.repeat(begin, size + 1)
        reach = stop - first[start]
        order = np.argsort(reach * np.int64(len(text) + 1) + start)
        start, stop, piece, reach = start[order], stop[order], piece[order], reach[order]
        last = np.full(len(text) + 1, -2)
        last[begin] = -1  # the beginning of a word stands with anything
        came = np.zeros(len(text) + 1, np.int64)
        steps = np.concatenate([[0], np.flatnonzero(np.diff(reach)) + 1, [len(reach)]])
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            s, e, t = start[a:b], stop[a:b], piece[a:b]
            before = last[s]
            ok = before != -2
            ask = np.flatnonzero(ok & (before >= 0) & (t >= 0))
            ok[ask] = self.stand(before[ask], t[ask])
            last[e[ok]] = t[ok]
            came[e[ok]] = s[ok]

        # Back from the end of every word; byte pieces take a step each.
        at, word = begin + size, np.arange(len(size))
        got, of = [], []
        while len(at):
            t, s = last[at], came[at]
            got.append(t << 32 | s)
            of.append(word)
            on = s > begin[word]
            at, word = s[on], word[on]
        step = np.repeat(np.arange(len(got)), [len(g) for g in got])
        got, of = np.concatenate(got), np.concatenate(of)
        order = np.lexsort((-step, of))
        t, s, of = got[order] >> 32, got[order] & 0xFFFFFFFF, of[order]
        lone = t < 0
        if not lone.any():
            return t.astype(np.uint32), np.bincount(of, minlength=len(size))
        n = np.where(lone, _width(text, s), 1)
        if table.byte:
            byte = np.zeros(256, np.int64)
            byte[list(table.byte)] = list(table.byte.values())
            ids = np.repeat(t, n)
            ids[np.repeat(lone, n)] = byte[text[gather(s[lone], n[lone])]]
            return ids.astype(np.uint32), np.bincount(np.repeat(of, n), minlength=len(size))
        t = np.where(lone, table.unknown, t)
        keep = ~lone | ~np.concatenate([[False], lone[:-1] & (of[1:] == of[:-1])])
        return t[keep].astype(np.uint32), np.bincount(of[keep], minlength=len(size))

    def stand(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Remembered answers, others found together."""
        pair = x << 20 | y
        place = (mix(pair.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pairs[place] != pair)
        out = self.answers[place]
        if len(new):
            _, first, which = np.unique(pair[new], return_index=True, return_inverse=True)
            one = new[first]
            found = self.pieces.stand(x[one], y[one])
            out[new] = found[which]
            _, last = np.unique(place[one], return_index=True)
            self.pairs[place[one[last]]], self.answers[place[one[last]]] = pair[one[last]], found[last]
        return out


def _width(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = text[at]
    return np.select([c < 0x80, c < 0xE0, c < 0xF0], [1, 2, 3], 4)


class PieceDecoder:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        data = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            data.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(BLANK, " ").encode())
        self.pool, self.size = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; what is no UTF-8 becomes replacement characters."""
        size = self.size[ids]
        data = self.pool[gather(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


_made: dict = {}


def _once(kind, path: str):
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _once(PieceEncoder, model)
        for batch in batches:
            for rows, buf, offs in text_pieces(batch, "t"):
                ids, n = enc.texts(buf, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*rows.schema.names[:-1], "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """doc_id, ids and the ``text`` they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _once(PieceDecoder, model)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            got = dec.texts(np.asarray(lists.flatten()), np.asarray(lists.value_lengths()))
            texts = pa.array(got, pa.binary()).cast(pa.string())
            if batch.column(1).null_count:
                texts = pa.compute.if_else(batch.column(1).is_valid(), texts, None)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    src = encoded.select("doc_id", F.col(ids).alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned 32-bit little-endian ids), text_sha256 of the text decoded from these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _once(PieceEncoder, model), _once(PieceDecoder, model)
        for batch in batches:
            for rows, buf, offs in text_pieces(batch, "t"):
                ids, n = enc.texts(buf, offs)
                packed = ids.astype("<u4").tobytes()
                ends = np.cumsum(n)
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                sha = [hashlib.sha256(t).hexdigest() for t in dec.texts(np.frombuffer(packed, "<u4"), n)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(n), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text_sha256"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_ids bigint, ids_crc32 bigint, text_sha256 string")
