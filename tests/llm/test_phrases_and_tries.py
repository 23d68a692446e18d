"""Prefix tries and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import phrase_index, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, place bigint, key string, conv string, depth int, n int"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "k", "c", 3, 4) for r in rows], TURNS)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        parents = {m[:-1] for m in members if m}
        ends = sorted(c for c in who if built[c] == node)
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(1 for m in members if m and m[:-1] == node), sum(m not in parents for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def test_prefix_trie(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"say {t} é" if t < 3 + c % 2 else f"own {c} {t}") for c in range(12) for t in range(1 + c % 7)]
    rows += [(20, None, None, None), (20, 1, "user", "x"), (20, 1, "user", "x"), (20, 1, "tool", "x"), (21, 0, "user", ""), (None, 0, "user", "lost"), (22, 5, None, "late"), (23, 0, "user", "a\nb"), (24, 0, "user\na", "b")]
    rows += [(c, t, "user", f"same {t}") for c in (100, 105, 110, 115, 120) for t in range(30)]  # long copies
    rows += [(c, t, "user", f"same {t}" if t < 12 else f"tail {c} {t}") for c in (130, 135) for t in range(20)]
    got = prefix_trie.trie(prefix_trie.rebuilt(turn_frame(spark, rows).repartition(3))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_tries_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(turn_frame(spark, []))).count() == 0
    rows = [(c, 0, "user", "gone") for c in (1, 2, 3, 4)]  # their base is absent and each has one turn
    got = prefix_trie.trie(prefix_trie.rebuilt(turn_frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


PHRASE = "doc_id bigint, text string, lang string, phrase string, f bigint, word string, shard bigint, id bigint"


def brute_collocations(rows, most, least, share, top):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n["und" if lang is None else lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= share * a for b in longer):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=160):
    r = random.Random(seed)
    vocab = ["a", "B", "the", "of", "é", "Straße", "x" * 40, "y" * 40, "1", "#", " ", "don't", "\x01", "b" * 23, "b" * 24]
    say = lambda k: "".join(r.choice(vocab[: r.randint(3, 15)]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(k))
    rows = [(i, say(r.randint(0, 30)), r.choice(["en", "en", "fr", None, ""])) for i in range(n)]
    return rows + [(None, None, None), (1, "", "en"), (2, " ,.\n", "de"), (3, "new york city " * 400, "en"), (3, "new york city " * 5, "en"), (4, "z" * 5000, "en")]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations(spark, most):
    rows = phrase_rows(most)
    docs = spark.createDataFrame([(*r, "p", 3, "w", 5, 6) for r in rows], PHRASE).repartition(3)
    got = phrase_index.collocations(docs, most, 10, 50, 60).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, most, 10, 50, 60)
    assert phrase_index.collocations(docs.limit(0), most).count() == 0


def test_shards_hold_whole_texts(spark):
    rows = phrase_rows(7)
    docs = spark.createDataFrame([(*r, "p", 3, "w", 5, 6) for r in rows], PHRASE).repartition(2)
    small = phrase_index.word_counts(phrase_index.shards(docs, size=300, held=900)).collect()
    assert sorted(small) == sorted(phrase_index.word_counts(phrase_index.shards(docs)).collect())


def test_scores_beyond_64_bits(spark):
    rows = [(3 * 10**9, 4 * 10**9, 5 * 10**9), (7, 7, 7), (999_999_999_999, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(phrase_index._score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [g[0] for g in got] == [1_000_000 * a * a // (l * r) for a, l, r in rows]  # noqa: E741
