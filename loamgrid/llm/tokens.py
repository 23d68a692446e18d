"""Whole-text token ids from a tokenizer file, remembering the ids of frequent words in each Python worker.

Byte-pair tokenizers split texts before they merge, so a text can be cut where they split without changing any id.
Words of up to ``SHORT`` bytes are remembered by their bytes themselves, eight at a time in three integers, so a look-up
is a handful of array operations for a whole piece of text and never mistakes one word for another. Only new words go
to the tokenizer, joined into one long string. What a worker remembers is bounded by ``REMEMBER``; beyond that, further
words are encoded in each piece of text they come in, as longer words are. Files whose rules don't allow cutting are
run over whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from loamgrid.llm.arrays import gather, mix, words

#: Words a Python worker keeps; about 60 bytes each.
REMEMBER = 1 << 20
#: Longest word that is remembered.
SHORT = 23

#: ASCII white space and separators, and lead bytes of characters some of which are white space.
_DOUBT = np.zeros(256, bool)
_DOUBT[[*range(9, 14), *range(28, 33), 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _plain_around(buf: np.ndarray, offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether there is certainly no white space on either side of the ASCII characters at these places."""
    # Zeros around stand for the ends of texts, which are no white space.
    wide = np.concatenate([np.zeros(4, np.uint8), buf, np.zeros(1, np.uint8)])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = wide[at + 3]
    lead = np.where(before < 0x80, before, np.where(wide[at + 2] >= 0xC0, wide[at + 2], np.where(wide[at + 1] >= 0xC0, wide[at + 1], 0)))
    return (edge[at] | ~_DOUBT[lead]) & (edge[at + 1] | ~_DOUBT[wide[at + 5]])


def lone(buf: np.ndarray, offs: np.ndarray, char: int) -> np.ndarray:
    """Places of a white-space character with certainly no white space on either side."""
    at = np.flatnonzero(buf == char)
    return at[_plain_around(buf, offs, at)] if len(at) else at


def stops_after_letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of a full stop, comma and the like right after an ASCII letter of the same text."""
    at = np.flatnonzero(_STOP[buf[1:]] & _LETTER[buf[:-1]]) + 1
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    return at[~edge[at]]


class WordTable:
    """Numbers of short words and the ids of each, in arrays."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.keys = np.zeros((1024, 3), np.uint64)
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.slots = np.full(4096, -1, np.int32)

    @staticmethod
    def names(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes and the length of each word in three integers."""
        wide = np.concatenate([buf, np.zeros(24, np.uint8)])
        view = np.ndarray((len(buf) + 17,), "<u8", wide, strides=(1,))
        out = np.empty((len(start), 3), np.uint64)
        for i in range(3):
            at = start if not i else np.minimum(start + 8 * i, len(buf))
            out[:, i] = view[at] & _MASK[np.clip(size - 8 * i, 0, 8)]
        out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        return out

    @staticmethod
    def scatter(names: np.ndarray) -> np.ndarray:
        return mix(names[:, 0] ^ mix(names[:, 1] ^ mix(names[:, 2])))

    def find(self, names: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if new."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(names), -1, np.int64)
        left, slot = np.arange(len(names)), (hashes & mask).astype(np.int64)
        while len(left):
            at = self.slots[slot]
            want, got = names[left], self.keys[at]
            same = (want[:, 0] == got[:, 0]) & (want[:, 1] == got[:, 1]) & (want[:, 2] == got[:, 2]) & (at >= 0)
            out[left[same]] = at[same]
            on = ~same & (at >= 0)
            left, slot = left[on], (slot[on] + 1) & int(mask)
        return out

    def add(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray, keep: bool) -> np.ndarray:
        """Numbers of new words; those not to be kept go with ``drop``."""
        first, m, total = self.n, len(names), int(counts.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.keys) < first + m:
            self.keys, self.starts, self.counts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.keys, self.starts, self.counts))
        self.flat[self.used : self.used + total] = ids
        self.keys[first : first + m] = names
        self.starts[first : first + m] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + m] = counts
        if keep:
            self.n, self.used = first + m, self.used + total
            if 2 * self.n > len(self.slots):
                self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
                self._seat(np.arange(self.n))
            else:
                self._seat(np.arange(first, self.n))
        return np.arange(first, first + m)

    def _seat(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.scatter(self.keys[numbers]) & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            on = self.slots[slot] != numbers
            numbers, slot = numbers[on], (slot[on] + 1) & mask


class WordEncoder:
    """Encodes texts to ids exactly as the tokenizer file does, without special tokens added."""

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule = cutting_rule(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        end = spec["model"].get("end_of_word_suffix") or ""
        self.lowers = self.rule == "blank" and any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.size, self.closes = np.zeros(max(vocab.values()) + 1, np.int64), np.zeros(max(vocab.values()) + 1, bool)
        self.size[list(vocab.values())] = [len(k) for k in vocab]
        self.closes[[i for k, i in vocab.items() if end and k.endswith(end)]] = True
        self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.merges = None
        if self.rule == "led" and not end or self.rule == "blank" and end:
            # The same vocabulary and merges for words that need no splitting and normalising.
            self.merges = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        self.remember = remember
        self.table = WordTable()

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        if self.lowers:
            low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
            if not any(a.encode() in low.tobytes() for a in self.added):
                buf = low
        start, stop, bounds = self.cuts(buf, offs)
        size, table = stop - start, self.table
        number = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(size <= SHORT) if len(size) and size.max() > SHORT else None
        names = table.names(buf, *((start, size) if short is None else (start[short], size[short])))
        hashes = table.scatter(names)
        found = table.find(names, hashes)
        new = np.flatnonzero(found < 0)
        extra = []
        if len(new):
            order = np.lexsort((names[new, 0], names[new, 1], names[new, 2]))
            ranked = names[new[order]]
            first = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
            one = new[order[first]]
            at = one if short is None else short[one]
            ids, counts = self.encode(buf, start[at], stop[at])
            if table.n + len(one) <= self.remember:
                found[new[order]] = table.add(names[one], ids, counts, True)[np.cumsum(first) - 1]
            else:
                extra.append((ids, counts))
                found[new[order]] = table.n + np.cumsum(first) - 1
        if short is None:
            number = found
        else:
            number[short] = found
            data, n_new = buf.tobytes(), sum(len(c) for _, c in extra)
            far = np.flatnonzero(size > SHORT)
            seen: dict[bytes, int] = {}
            number[far] = [table.n + n_new + seen.setdefault(data[a:b], len(seen)) for a, b in zip(start[far].tolist(), stop[far].tolist())]
            ends = np.cumsum([len(k) for k in seen])
            extra.append(self.encode(np.frombuffer(b"".join(seen), np.uint8), ends - [len(k) for k in seen], ends))
        if extra:
            ids, counts = np.concatenate([e[0] for e in extra]), np.concatenate([e[1] for e in extra])
            table.add(np.zeros((len(counts), 3), np.uint64), ids, counts, False)
        n = table.counts[number]
        got = table.flat[gather(table.starts[number], n)]
        return got, np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, stops, words before each text) of the parts that can be encoded on their own."""
        begin = offs[:-1][np.diff(offs) > 0]
        if self.rule == "whole" or not len(buf):
            return begin, begin + np.diff(offs)[np.diff(offs) > 0], np.searchsorted(begin, offs)
        if self.rule == "blank":
            start, stop, _ = words(buf, offs)
            inner = stops_after_letters(buf, offs)
            start, stop = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([stop, inner]))
            return start, stop, np.searchsorted(start, offs)
        line = lone(buf, offs, 10)
        cut = np.zeros(len(buf) + 1, bool)
        for at in (begin, lone(buf, offs, 32), line, line + 1, stops_after_letters(buf, offs)):
            cut[at] = True
        start = np.flatnonzero(cut[:-1])
        return start, np.concatenate([start[1:], [len(buf)]]), np.searchsorted(start, offs)

    def encode(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each word) of different words."""
        size = stop - start
        body = buf[gather(start, size)]
        ends = np.cumsum(size)
        simple = np.zeros(len(start), bool)
        if self.merges is not None and len(start):
            lead = int(self.rule == "led")
            letters = np.concatenate([[0], np.cumsum(_LETTER[body])])
            simple = (letters[ends] - letters[ends - size] == size - lead) & (size > lead) & (body[ends - size] == 32 if lead else True)
        told = [np.zeros(0, np.uint32)]
        counts = np.zeros(len(start), np.int64)
        groups = []
        for which, one in ((np.flatnonzero(simple), self.merged), (np.flatnonzero(~simple), self.encode_others)):
            if len(which):
                ids, counts[which] = one(body[gather((ends - size)[which], size[which])], size[which])
                told.append(ids)
                groups.append(which)
        if len(groups) < 2:
            return told[-1], counts
        order = np.concatenate(groups)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(told)[gather(begin, counts)], counts

    def merged(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of ASCII letters pass the splitting rule whole, so they only need their merges."""
        if self.rule == "led":
            text = body.tobytes().decode().replace(" ", " Ġ")
        else:
            spaced = np.full(len(body) + len(size), 32, np.uint8)
            spaced[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body
            text = spaced.tobytes().decode().lower() if self.lowers else spaced.tobytes().decode()
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if self.rule == "led":
            bounds = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size)) + 1
        else:
            bounds = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.diff(bounds, prepend=0)

    def encode_others(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, ends = body.tobytes(), np.cumsum(size)
        keys = [data[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
        told: list[list[int] | None] = [None] * len(keys)
        plain = [i for i, k in enumerate(keys) if self.is_plain(k)]
        for lo in range(0, len(plain), 20_000):
            part = plain[lo : lo + 20_000]
            got = self.joined([keys[i] for i in part])
            if got is None:
                continue
            ids, bounds = got[0].tolist(), got[1].tolist()
            for i, a, b in zip(part, bounds, bounds[1:]):
                told[i] = ids[a:b]
        odd = [i for i, t in enumerate(told) if t is None]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([keys[i].decode() for i in odd], add_special_tokens=False) if odd else ()):
            told[i] = e.ids
        counts = np.fromiter(map(len, told), np.int64, len(told))
        return np.fromiter(chain.from_iterable(told), np.uint32, int(counts.sum())), counts

    def is_plain(self, key: bytes) -> bool:
        """Whether a word may be joined with others."""
        if self.rule == "whole" or len(key) > 200:
            return False
        word = key.decode()
        if self.rule == "led" and word[:1] == " ":
            word = word[1:]
        return "\x01" not in word and word.split() == [word]

    def joined(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, bounds) of words that pass the tokenizer as one string; none if they cannot."""
        if self.rule == "blank":
            text = b" \x01 ".join([*keys, b""]).decode()
        else:
            # A blank leads its word; other words stand after a line feed.
            parts = [k if k[:1] == b" " else b"\n" + k for k in keys]
            text = b"".join(parts).decode()
        if any(a in text for a in self.added):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if self.rule == "blank":
            if len(self.mark) != 1:
                return None
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(keys):
                return None
            return np.delete(ids, at), np.concatenate([[0], at - np.arange(len(at))])
        end = np.concatenate([[0], np.cumsum(self.size[ids])])
        stop = np.cumsum([len(p) for p in parts])
        fed = np.array([k[:1] != b" " for k in keys])
        begin = stop - [len(k) for k in keys]
        a, b = np.searchsorted(end, begin), np.searchsorted(end, stop)
        if end[-1] != stop[-1] or (end[a] != begin).any() or (end[b] != stop).any():
            return None
        keep = np.ones(len(ids), bool)
        keep[a[fed] - 1] = False
        return ids[keep], np.concatenate([[0], np.cumsum(b - a)])


def cutting_rule(spec: dict) -> str:
    """``blank``: texts may be cut at white space, which is dropped; ``led``: at single blanks, which lead the next word.
    Both may be cut between an ASCII letter and a stop."""
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
        return "whole"
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] == "BPE":
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "led"
        split = (pre.get("pretokenizers") or [{}])[0]
        if split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "") and {n["type"] for n in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            return "blank"
    return "whole"


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
