"""Small tables with the awkward rows every operator must take, and brute-force answers."""

import random
import re

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, t string, row string, node bigint, component_id string, host_key string, start bigint, __text string"


def awkward(seed=3, n=40):
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, near copies, a hot source, repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéüß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, base = say(40), say(120).split()
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t", "en", "a", 5), (3, "12 34 !!", None, "a", 8), (4, "Solo", "en", "b", 4)]
    for i in range(5, n):
        k = i % 8
        text = say(r.randint(60, 120)) if k < 3 else f"{say(30)} {passage} {say(30)}" if k < 5 else "\n".join([say(12)] * 6) if k == 5 else None
        if k == 6:
            text = " ".join(base)
        if k == 7:
            words = list(base)
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        rows.append((i, text, ["en", "fr"][i % 2], "hot" if i % 3 else f"s{i % 4}", len(text)))
    rows.append((n, say(9000), "fr", "hot", 0))
    rows += [rows[9], rows[9], (None, rows[10][1], "en", None, 1), (n + 1, "😀 x​y\r\n" + passage, "en", "b", 1), (n + 2, "word " * 70, "en", "b", 1)]
    return rows


def frame(spark, rows):
    """With further columns whose names operators might use themselves."""
    return spark.createDataFrame([(*r, "x", None, "y", 7, "z", "h", 5, "q") for r in rows], EXTRA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
