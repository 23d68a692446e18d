"""Language identification with error-correcting output codes.

Every language gets a binary codeword. For each bit one naive Bayes classifier over hashed byte n-grams says on which
side a text lies; the codeword with the smallest weighted logistic loss wins. Bits whose classifiers separate well
weigh more. A decision is flagged ambiguous when the second codeword is nearly as close.

Model size: ``buckets`` n-gram counts per language, the only data the driver sees; they are sums over *all* training
rows. Defined cases: null texts and texts without a letter are ``und`` with score 0; training rows without language
or text are left out; with no training row at all every text is ``und``; texts of one or two bytes show nothing and are ambiguous; repeated rows count each; ties go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.arrays import pieces

UNKNOWN = "und"
BUCKETS = 1 << 14
PIECE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
#: Everything in ASCII that is no letter counts as a space.
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


def ngrams(buf: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the three folded bytes that end at each position."""
    x = _LOWER[buf]
    key = x * np.uint32(0x9E3779B1)
    key[1:] += x[:-1] * np.uint32(0x85EBCA77)
    key[2:] += x[:-2] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def inside(offs: np.ndarray) -> np.ndarray:
    """Whether the three bytes that end at each position are all of one text."""
    return np.arange(offs[-1]) - np.repeat(offs[:-1], np.diff(offs)) >= 2


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])[offs]
    out = np.diff(seen) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in bytes(buf[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to five languages every split of the languages is a bit, beyond that 15 log2(n) drawn splits."""
    if n < 2:
        return np.ones((n, 0), int)
    if n <= 5:
        ks = range(1, 1 << max(0, n - 1))
        return np.array([[1 if l == n - 1 or not k >> l & 1 else -1 for k in ks] for l in range(n)]).reshape(n, -1)
    rng, bits = np.random.Generator(np.random.PCG64(11)), int(np.ceil(15 * np.log2(n)))
    best, far = None, -1
    for _ in range(32):
        c = rng.choice([-1, 1], (n, bits))
        d = (bits - c @ c.T)[~np.eye(n, dtype=bool)].min() if abs(c.sum(0)).max() < n else -1
        if d > far or best is None:
            best, far = c, d
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    #: Log-odds of each bucket for each bit.
    odds: np.ndarray
    bit_weight: np.ndarray
    #: Mean n-gram evidence is scaled by this and by how many n-grams there are.
    scale: float = 6.0
    #: Loss gap below which a decision is ambiguous.
    gap: float = 0.02

    def losses(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)[:, None]
        margin = sums / n * self.scale * np.minimum(1, np.sqrt(n / 40))
        z = margin[:, None, :] * self.code[None]
        return (np.logaddexp(0, -z) * self.bit_weight).sum(2)


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS, smooth: float = 1.0) -> LanguageModel:
    """Counts n-grams by language over all given rows and derives the bit classifiers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, buf, offs in pieces(batch, "t"):
                names = part.column(0).to_pylist()
                grams = ngrams(buf, buckets)
                known = sorted(set(names))
                of = np.repeat([known.index(x) for x in names], np.diff(offs))
                got = np.bincount((grams + of * buckets)[inside(offs)], minlength=buckets * len(known)).reshape(len(known), -1)
                for name, c in zip(known, got):
                    total[name] = total.get(name, 0) + c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], ["l", "f", "c"])

    src = rows.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    summed = src.mapInArrow(count, "l string, f bigint, c bigint").groupBy("l", "f").agg(F.sum("c").alias("c"))
    per_lang = summed.groupBy("l").agg(F.collect_list(F.struct("f", "c")).alias("fc")).orderBy("l").toArrow()
    names = tuple(per_lang.column("l").to_pylist())
    counts = np.zeros((len(names), buckets))
    for i, fc in enumerate(per_lang.column("fc").chunks and [x for ch in per_lang.column("fc").chunks for x in ch] or []):
        counts[i, fc.values.field("f").to_numpy()] = fc.values.field("c").to_numpy()
    return model_from_counts(names, counts, smooth)


def model_from_counts(names: tuple[str, ...], counts: np.ndarray, smooth: float = 1.0) -> LanguageModel:
    code = codewords(len(names))
    share = (counts + smooth) / (counts + smooth).sum(1, keepdims=True) if len(names) else counts
    odds, weight = [], []
    for bit in code.T:
        p, q = share[bit > 0].mean(0), share[bit < 0].mean(0)
        w = np.log(p) - np.log(q)
        odds.append(w)
        weight.append(min((p * w).sum(), -(q * w).sum()))
    weight = np.array(weight) / max(sum(weight), 1e-9)
    return LanguageModel(names, code, np.array(odds, np.float32).T.copy().reshape(counts.shape[1], -1), weight)


def classify_piece(model: LanguageModel, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text."""
    n = np.diff(offs)
    letters = has_letter(buf, offs)
    if len(model.languages) < 2:
        only = model.languages[0] if model.languages else UNKNOWN
        return [only if x else UNKNOWN for x in letters], np.where(letters & (only != UNKNOWN), 1.0, 0.0), np.zeros(len(n), bool)
    sums = np.zeros((len(n), model.odds.shape[1]))
    full = n > 0
    if len(buf):
        odds = model.odds[ngrams(buf, model.odds.shape[0])]
        odds[~inside(offs)] = 0
        sums[full] = np.add.reduceat(odds, offs[:-1][full], dtype=np.float64)
    loss = model.losses(sums, np.maximum(n - 2, 0))
    best = loss.argmin(1)
    order = np.sort(loss, 1)
    like = np.exp(-8 * (loss - order[:, :1]))
    score = np.where(letters, 1 / like.sum(1), 0.0)
    return [model.languages[b] if x else UNKNOWN for b, x in zip(best, letters)], score, letters & (order[:, 1] - order[:, 0] < model.gap)


def identify(docs: DataFrame, model: LanguageModel, keep: list[Column | str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("__text"))
    names = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for rows, buf, offs in pieces(batch, "__text", PIECE):
                lang, score, amb = classify_piece(m, buf, offs)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(amb)], [*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text shows a language: rejected are ``und`` texts and those whose decoding is ambiguous.

    The codes are fitted on all labelled rows; the label ``und`` names no language. With fewer than two languages there
    is nothing to decide between, and only texts without a letter are rejected, also where there is no labelled row at all.
    """
    model = fit(docs.where(F.col(f"`{lang}`").cast("string") != UNKNOWN), lang, text)
    if not model.languages:
        # Any name will do for the one language that texts with a letter then have.
        model = replace(model, languages=("any",))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__t"))
    return identify(row, model, ["__row"], "__t").where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("__row.*")
