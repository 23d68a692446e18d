"""Quality rules with verdicts by host.

Every document is measured and held against rules. Failures are counted by host, the rate of each rule is shrunk
towards an empirical beta prior, so that a host with few pages is not judged by chance, and a host with a shrunk
rate above ``reject_rate`` loses all its documents.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows count each; an
empty table gives an empty result. Only the named columns are read, so further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.arrays import Hasher, mix, owner, pieces, repeated, words
from loamgrid.session import write_and_read

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


@dataclass(frozen=True)
class Limits:
    """Rules a document is held against."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    mean_word: tuple[float, float] = (2.0, 20.0)
    #: A host goes when the shrunk failure rate of any rule is above.
    reject_rate: float = 0.8


def measure_piece(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a piece."""
    n = len(offs) - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    h = Hasher(buf)
    starts, stops, bounds = words(buf, offs)
    doc = owner(bounds)
    ink = np.zeros(len(buf) + 1, np.int8)
    np.add.at(ink, starts, 1)
    np.add.at(ink, stops, -1)
    ink = np.cumsum(ink[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": np.diff(bounds), "word_chars": count(ink & ((buf & 0xC0) != 0x80)), "n_symbols": count(_SYMBOL[buf])}

    cut = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1, offs[1:]]))
    line_start, line_stop = cut[:-1], cut[1:].copy()
    if len(line_stop):
        line_stop -= buf[line_stop - 1] == 10
    full = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_stop)
    line_start, line_stop = line_start[full], line_stop[full]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    _, later = repeated(mix(h.ranges(line_start, line_stop) + mix(line_doc.astype(np.uint64))))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)

    covered = np.zeros(len(starts), bool)
    if len(starts) > 2:
        w = h.ranges(starts, stops)
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = mix(w[whole] + np.uint64(3) * mix(w[whole + 1] + np.uint64(5) * mix(w[whole + 2] + mix(doc[whole].astype(np.uint64)))))
        many, _ = repeated(key)
        for k in range(3):
            covered[whole[many] + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the measures of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in pieces(batch, "__text"):
                got = measure_piece(buf, offs)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(v, pa.int64()) for v in got.values())], [*keep, *got])

    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, {MEASURES}")


def base_failed(lim: Limits = Limits()) -> Column:
    return (F.col("n_words") < lim.min_words) | (100 * F.col("n_repeat_words") > lim.max_repeat_pct * F.col("n_words"))


def rules(lim: Limits = Limits()) -> dict[str, Column]:
    """True where a document fails."""
    w = F.col("n_words").cast("double")
    mean = F.col("word_chars") / F.greatest(w, F.lit(1.0))
    return {
        "base": base_failed(lim),
        "symbols": F.col("n_symbols") > lim.max_symbols_per_word * w,
        "dup_lines": F.col("n_dup_lines") > lim.max_dup_line_share * F.col("n_lines"),
        "word_length": (F.col("n_words") > 0) & ((mean < lim.mean_word[0]) | (mean > lim.mean_word[1])),
    }


def host_key(host: str) -> Column:
    """Never null, so that documents without a host meet their verdict in a plain join."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))


def host_verdicts(measured: DataFrame, host: str, lim: Limits = Limits()) -> DataFrame:
    """One row per host: ``host_key``, n_docs, shrunk rate of each rule, ``host_kept``.

    Prior by moments over hosts: the mean is that of all documents, the strength follows from how far the hosts'
    rates spread beyond chance. Counting is combined map-side, so a host with a third of all rows is no hot key.
    """
    rs = rules(lim)
    counts = measured.groupBy(host_key(host).alias("host_key")).agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(f"bad_{r}") for r, c in rs.items())
    )
    counts = write_and_read(counts, "hosts")
    n = F.col("n_docs").cast("double")
    total = counts.agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"bad_{r}").alias(r) for r in rs)).first()
    if not total["n"]:
        return counts.select("host_key", "n_docs", *(F.lit(0.0).alias(f"rate_{r}") for r in rs), F.lit(True).alias("host_kept"))
    means = {r: total[r] / total["n"] for r in rs}
    spread = counts.agg(*(F.sum(n * F.pow(F.col(f"bad_{r}") / n - means[r], 2)).alias(r) for r in rs)).first()
    shrunk = {}
    for r, m in means.items():
        chance = m * (1 - m)
        room = total["n"] - total["nn"] / total["n"]
        between = max(0.0, (spread[r] - (total["hosts"] - 1) * chance) / room) if room else 0.0
        strength = min(1e6, max(1.0, chance / between - 1)) if between > 0 and chance > 0 else 1e6 if chance > 0 else 1.0
        shrunk[r] = (F.col(f"bad_{r}") + m * strength) / (n + strength)
    return counts.select("host_key", "n_docs", *(c.alias(f"rate_{r}") for r, c in shrunk.items()), (F.greatest(*shrunk.values(), F.lit(0.0)) <= lim.reject_rate).alias("host_kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", lim: Limits = Limits()) -> DataFrame:
    """Measures, ``base_failed``, ``host_kept`` and ``kept`` of every row."""
    measured = write_and_read(measures(docs, list(dict.fromkeys([id_col, host])), text), "measures")
    verdicts = host_verdicts(measured, host, lim).select("host_key", "host_kept")
    out = measured.withColumn("base_failed", base_failed(lim)).withColumn("host_key", host_key(host)).join(verdicts, "host_key")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_key")


def keep_documents(docs: DataFrame, host: str = "source", text: str = "text", lim: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    fields = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in fields)).alias("__row"), F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__t"))
    verdicts = host_verdicts(write_and_read(measures(row, ["__host"], "__t"), "measures"), "__host", lim)
    gone = verdicts.where(~F.col("host_kept")).select("host_key")
    good = measures(row, ["__row", "__host"], "__t").where(~base_failed(lim)).withColumn("host_key", host_key("__host"))
    return good.join(gone, "host_key", "left_anti").select("__row.*")
