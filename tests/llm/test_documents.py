"""Operators on documents against brute force, on tables with awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loamgrid.llm import best_fit, bottom_k, curve_packing, host_rules, id_blocks, language_codes, prefix_doubling, progressive_jpeg, sentence_pieces
from loamgrid.llm.arrays import column_bytes
from loamgrid.llm.tokens import WordEncoder
from tests.llm.data import awkward, frame, shingles, words

ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def in_order(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


def test_host_rules(spark, docs, none):
    want = []
    for i, text, *_ in ROWS:
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(grams)
        again = {p for k, g in enumerate(grams) if many[g] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed))
    got = host_rules.judge(docs).collect()
    assert in_order(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    kept = host_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert in_order(kept.collect(), "doc_id", "text") == in_order([r for r in docs.collect() if not next(w for w in want if w[0] == r["doc_id"])[6]], "doc_id", "text")
    assert host_rules.judge(none).count() == 0 and host_rules.keep_documents(none).count() == 0


def test_host_verdict_takes_bad_hosts_whole(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "w " * 10
    rows = [(i, bad if i < 480 else good, "en", "junk", 1) for i in range(500)] + [(1000 + i, good, "en", f"h{i % 20}", 1) for i in range(400)] + [(5000, bad, "en", "tiny", 1), (5001, good, "en", "tiny", 1)]
    got = {r["doc_id"]: r["kept"] for r in host_rules.judge(frame(spark, rows)).collect()}
    assert not got[490] and got[1000] and got[5001] and not got[5000]


def test_language_codes(spark, none):
    r = np.random.default_rng(2)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "aflpq", "ee": "uvwxy", "ff": "zrstb"}
    rows = [(i, " ".join("".join(r.choice(list(letters[x]), 5)) for _ in range(20)), x, "s", 1) for i, x in enumerate(sorted(letters) * 30)]
    rows += [(900, None, "aa", "s", 1), (901, "123 !", "bb", "s", 1), (902, "abcde edcba", None, "s", 1), rows[0]]
    docs = frame(spark, rows)
    model = language_codes.fit(docs.where(~language_codes.held_out()))
    assert model.languages == tuple(sorted(letters)) and len(language_codes.codewords(6)[0]) > 30
    got = language_codes.identify(docs, model, ["doc_id", "lang", language_codes.held_out().alias("held_out")]).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    assert all(g["lang_pred"] == g["lang"] for g in got if g["doc_id"] < 900)
    assert {g["doc_id"]: g["lang_pred"] for g in got if g["doc_id"] >= 900} == {900: "und", 901: "und", 902: "aa"}
    assert {g["doc_id"] for g in got if g["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    kept = language_codes.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    blank = language_codes.fit(none)
    assert [g["lang_pred"] for g in language_codes.identify(docs.limit(3), blank, ["doc_id"]).collect()] == ["und"] * 3
    assert language_codes.keep_known(none).count() == 0


def test_language_stage_keeps_texts_when_no_language_is_known(spark):
    texts = [(0, "abcde edcba"), (1, "été"), (2, "12 !"), (3, None)]
    # With this shift the only labelled row is a held-out one.
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for label in ({}, {0: "und", 1: "und"}, {0: "aa"}):
        for shift in (0, out):
            docs = frame(spark, [(i + shift, t, label.get(i), "s", 1) for i, t in texts])
            assert in_order(language_codes.keep_known(docs).collect(), "doc_id") == [(shift,), (shift + 1,)]


def test_language_stage_drops_what_the_codes_cannot_tell(spark):
    rows = [(0, "abcabcabc" * 9, "a", "s", 1), (1, "xyzxyzxyz" * 9, "b", "s", 1), (2, "abcabcabc" * 9 + "xyzxyzxyz" * 9, None, "s", 1), (3, "12", None, "s", 1)]
    kept = language_codes.keep_known(frame(spark, rows)).collect()
    assert in_order(kept, "doc_id") == [(0,), (1,)]


def test_language_of_a_text_does_not_hang_on_its_neighbours(spark):
    assert language_codes.inside(np.array([0, 0, 1, 3, 3, 7])).tolist() == [False] * 5 + [True] * 2
    r = np.random.default_rng(4)
    rows = [(i, "".join(r.choice(list("abcde" if i % 2 else "defgh"), int(r.integers(1, 9)))), "ab"[i % 2], "s", 1) for i in range(300)]
    got = []
    for n in (1, 7):
        docs = frame(spark, rows).repartition(n)
        model = language_codes.fit(docs)
        got.append(in_order(language_codes.identify(docs, model, ["doc_id"]).collect(), "doc_id", "lang_pred", "score", "ambiguous"))
    assert got[0] == got[1]


def test_ambiguous_texts_are_flagged():
    counts = np.zeros((2, language_codes.BUCKETS))
    texts = [b"abcabcabc" * 9, b"xyzxyzxyz" * 9]
    for i, t in enumerate(texts):
        counts[i] = np.bincount(language_codes.ngrams(np.frombuffer(t, np.uint8)), minlength=language_codes.BUCKETS)
    model = language_codes.model_from_counts(("a", "b"), counts)
    data = [texts[0], texts[1], texts[0] + texts[1], b""]
    lang, score, amb = language_codes.classify_piece(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert lang[:2] == ["a", "b"] and lang[3] == "und" and score[3] == 0 and amb.tolist() == [False, False, True, False]


def test_near_duplicates(spark, docs, none):
    sets = [shingles(t) for _, t, *_ in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ROWS)):
        ids = [x for x in (least.get(find(i)), ROWS[i][0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    want = [(ROWS[i][0], len(sets[i]), least[find(i)] if sets[i] else ROWS[i][0]) for i in range(len(ROWS))]
    got = bottom_k.near_duplicates(docs).collect()
    assert in_order(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)
    one = bottom_k.keep_one_each(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == sorted({w[0] for w in want if w[0] == w[2]}, key=repr)
    assert bottom_k.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    say = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    texts = {None: [say("a"), say("b"), say("b"), say("c") + " x", "", None], 7: [say("d"), say("e") + " x", say("f"), ""], 3: [say("e")], 5: [say("c")]}
    rows = [(i, t, "en", "s", 1) for i, ts in texts.items() for t in ts]
    want = sorted([(None, say("a")), (None, say("b")), (None, ""), (None, None), (7, say("d")), (7, say("f")), (7, ""), (3, say("e")), (5, say("c"))], key=repr)
    for n in (1, 4):
        assert in_order(bottom_k.keep_one_each(frame(spark, rows).repartition(n)).collect(), "doc_id", "text") == want


def test_many_near_copies_make_one_component(spark):
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.integers(0, 200, 3):
            w[k] = f"x{r.integers(1 << 30)}"
        rows.append((i, " ".join(w), "en", "hot", 1))
    line = " ".join(f"common{i}" for i in range(20))
    rows += [(1000 + i, line + " " + " ".join(f"u{i}_{k}" for k in range(60)), "en", "hot", 1) for i in range(150)]
    got = bottom_k.near_duplicates(frame(spark, rows)).collect()
    sets = {i: shingles(t) for i, t, *_ in rows[:150]}
    linked = {0}
    while True:
        more = {i for i in sets if i not in linked and any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in linked)}
        if not more:
            break
        linked |= more
    assert {g["doc_id"] for g in got if g["component_id"] == 0} == linked
    assert all(g["kept"] for g in got if g["doc_id"] >= 1000)


def brute_repeats(rows):
    starts = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            starts[s] = min(starts.get(s, 1 << 70), 1 << 63 if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        own, hit = 1 << 63 if i is None else i, bytearray(len(b))
        for p in range(len(b) - 49):
            if starts[b[p : p + 50]] < own:
                hit[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((i, len(b), sum(hit), sum(1 for p, h in enumerate(hit) if h and (not p or not hit[p - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats(spark, docs, none):
    want = brute_repeats(ROWS)
    got = prefix_doubling.remove_repeats(docs).collect()
    assert in_order(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((w[:5] for w in want), key=repr)
    stage = prefix_doubling.without_repeats(docs)
    assert stage.columns == docs.columns
    by = {(i, t): w[5].decode("utf-8", "ignore") for (i, t, *_), w in zip(ROWS, want)}
    plain = {r[0]: r[1] for r in ROWS}
    for r in stage.collect():
        assert r["text"] in {v for (i, _), v in by.items() if i == r["doc_id"]} | ({None} if plain[r["doc_id"]] is None else set())
    assert prefix_doubling.remove_repeats(none).count() == 0


def test_repeats_in_many_rows_without_id(spark):
    r = np.random.default_rng(12)
    say = lambda k: bytes(r.integers(97, 123, k)).decode()
    passage = say(80)
    rows = [(1, say(20) + passage + say(20), "en", "s", 1)]
    rows += [(None, say(int(r.integers(0, 60))) + passage + say(30), "en", "s", 1) for _ in range(3000)]
    rows += [(7, say(60) + passage[:60], "en", "s", 1) for _ in range(20)] + [rows[5], rows[5]]
    want = sorted((w[:5] for w in brute_repeats(rows)), key=repr)
    assert in_order(prefix_doubling.remove_repeats(frame(spark, rows)).collect(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    kept = Counter(hashlib.sha256(x["text"].encode()).hexdigest() for x in prefix_doubling.without_repeats(frame(spark, rows)).collect())
    assert kept == Counter(w[4] for w in want)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_in_periodic_and_cut_texts(spark, seed):
    r = np.random.default_rng(seed)
    rows, soup = [], bytes(r.integers(97, 100, 400)).decode()
    for i in range(30):
        a = int(r.integers(0, 340))
        parts = [soup[a : a + int(r.integers(40, 70))], "ab" * int(r.integers(0, 60)), "z" * int(r.integers(0, 90)), bytes(r.integers(97, 123, 30)).decode()]
        r.shuffle(parts)
        rows.append((int(r.integers(0, 25)) * 10 + i % 2, "".join(parts), "en", "s", 1))
    rows = [(i, *x[1:]) for i, x in zip(sorted({x[0] for x in rows}), rows)]
    got = prefix_doubling.remove_repeats(frame(spark, rows)).collect()
    assert in_order(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((w[:5] for w in brute_repeats(rows)), key=repr)


def tokens(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*t.encode(x[1] or "", add_special_tokens=False).ids, end] for x in ROWS]


def test_packing(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = tokens("byte_bpe_50k.json", 0)
    got = sorted(curve_packing.pack_documents(docs, path, 128).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in got:
        assert r["sequence_id"] * 128 + r["offset"] == place and r["length"] > 0 and r["offset"] + r["length"] <= 128
        place += r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        assert any(x[0] == r["doc_id"] and len(t) == r["doc_tokens"] and np.array(t[r["start"] : r["start"] + r["length"]], "<u4").tobytes() == r["ids"] for x, t in zip(ROWS, ids))
    assert place == sum(map(len, ids))
    assert curve_packing.pack_documents(none, path).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits, dims = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = curve_packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_id_files(spark, docs, none):
    folder = id_blocks.new_folder(docs)
    listing = id_blocks.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder, ids_per_file=500)
    assert listing.agg({"n_docs": "sum"}).first()[0] == len(ROWS)
    got = sorted(id_blocks.read_documents(listing, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((x[0] for x in ROWS), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    want = [(x[0], len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for x, t in zip(ROWS, tokens("word_bpe_49k.json", 2))]
    assert in_order(got, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert id_blocks.read_documents(id_blocks.write_ids(none, public_tokenizers.path("word_bpe_49k.json"), folder + "-none"), folder + "-none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_id_blocks(n):
    r = np.random.default_rng(n)
    x = r.integers(0, 1 << r.integers(1, 33, n), n, dtype=np.uint64).astype(np.uint32)
    f = id_blocks.IdFile(id_blocks.to_file([None, 5], np.array([n // 2, n - n // 2]), x))
    assert (f.ids() == x).all() and (f.ids(n // 3, n // 2) == x[n // 3 : n // 2]).all() and f.null.tolist() == [True, False]


def test_media(spark, docs, none):
    stored = progressive_jpeg.store(docs)
    got = progressive_jpeg.features(stored).collect()
    want = []
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        p = progressive_jpeg.padded(b)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert in_order(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    same = [tuple(g)[2:] for g in got if g["doc_id"] == ROWS[9][0]]
    assert len(same) == 3 and len(set(same)) == 1
    x = progressive_jpeg.tensors(stored.where("doc_id = 4")).first()
    assert len(x["rgb"]) == x["height"] * x["width"] * 3
    assert progressive_jpeg.features(progressive_jpeg.store(none)).count() == 0


def test_features_come_from_stored_tensors(spark, docs, monkeypatch):
    want = sorted(map(tuple, progressive_jpeg.features(progressive_jpeg.store(docs)).collect()), key=repr)
    pictures, settle = [], progressive_jpeg.settle

    def spy(df, name, **kw):
        out = settle(df, name, **kw)
        if name == "tensors":
            pictures.extend(out.collect())
        return out

    monkeypatch.setattr(progressive_jpeg, "settle", spy)
    monkeypatch.setattr(progressive_jpeg, "FILE_ROWS", 2)
    monkeypatch.setattr(progressive_jpeg, "SLICES", 3)
    stored = progressive_jpeg.store(docs)
    assert sorted(map(tuple, progressive_jpeg.features(stored).collect()), key=repr) == want
    shapes = [(p["doc_id"], p["rgb"]) for p in pictures]
    files = [(r["doc_id"], progressive_jpeg.Picture(bytes(r["media"])).rgb().tobytes()) for r in stored.collect()]
    assert sorted(shapes, key=repr) == sorted(files, key=repr) and len(shapes) == len(ROWS)


def test_sentence_pieces(spark, docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentence_pieces.decode(sentence_pieces.encode(docs, path), path).collect()
    assert in_order(got, "doc_id", "ids", "text") == sorted(((i, sp.encode(t or ""), t or "") for i, t, *_ in ROWS), key=repr)
    trip = sentence_pieces.round_trip(docs, path).collect()
    want = [(i, len(e), zlib.crc32(np.array(e, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS for e in [sp.encode(t or "")]]
    assert in_order(trip, "doc_id", "n_ids", "ids_crc32", "text_sha256") == sorted(want, key=repr)
    assert sentence_pieces.round_trip(none, path).count() == 0


def thue_morse(n):
    """Two words of 2^n letters whose sums of letters times powers are equal for every base modulo 2^64 (n = 10)."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_are_told_apart_by_their_bytes(spark):
    a, b = thue_morse(10)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, enc = Tokenizer.from_file(public_tokenizers.path(name)), WordEncoder(public_tokenizers.path(name))
        texts = [a, b, f"{a} {b}", "ab" * 40 + " x", "a\0 a", "Die Straße, die.", "x,\n\ny", None]
        for _ in range(2):  # new words, then remembered ones
            ids, n = enc.texts(*column_bytes(pa.array(texts)))
            at = np.concatenate([[0], np.cumsum(n)])
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    rows = [(1, "p q r s " + a, "en", "x", 1), (2, "p q r s " + b, "en", "x", 1), (3, "u v\n" + a + "\n" + b + "\n" + a, "en", "x", 1)]
    got = {r["doc_id"]: r for r in bottom_k.near_duplicates(frame(spark, rows)).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 3]
    assert {r["doc_id"]: r["n_dup_lines"] for r in host_rules.judge(frame(spark, rows)).collect()}[3] == 1


def test_remembering_nothing_changes_no_id():
    path, r = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(4)
    texts = ["".join(r.choice(list("abCD ,.é\n'1")) for _ in range(60)) for _ in range(300)]
    t = Tokenizer.from_file(path)
    for remember in (0, 50, 1 << 20):
        enc = WordEncoder(path, remember)
        for lo in range(0, 300, 100):
            ids, n = enc.texts(*column_bytes(pa.array(texts[lo : lo + 100])))
            at = np.concatenate([[0], np.cumsum(n)])
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts[lo : lo + 100]]


def test_many_rows_without_id_are_near_duplicates_by_row(spark):
    r = np.random.default_rng(8)
    say = lambda: " ".join(f"w{k}" for k in r.integers(0, 5000, 30))
    rows = [(None, say(), "en", "s", 1) for _ in range(3000)]
    rows += [(None, rows[5][1], "en", "s", 1), (4, rows[9][1] + " more", "en", "s", 1)]
    got = bottom_k.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 3002 and sum(g["component_id"] == 4 for g in got) == 2
    assert len(bottom_k.keep_one_each(frame(spark, rows)).collect()) == 3000


def test_best_fit(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = tokens("word_bpe_49k.json", 1)
    packed = best_fit.pack_documents(docs, path, 128, most=4, group_tokens=2000).collect()
    got = sorted(packed, key=lambda r: (r["sequence_id"], r["offset"]))
    ends = {}
    for r in got:
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 128
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    want = sorted(((x[0], k, 128 * k, len(t[128 * k : 128 * k + 128]), zlib.crc32(np.array(t[128 * k : 128 * k + 128], "<u4").tobytes())) for x, t in zip(ROWS, ids) for k in range(-(-len(t) // 128))), key=repr)
    assert in_order(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    assert all(np.array(np.frombuffer(r["ids"], f"<u{r['width']}"), "<u4").tobytes() for r in got if zlib.crc32(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()) == r["ids_crc32"])
    least = -(-sum(map(len, ids)) // 128)
    assert len(ends) <= 1.15 * least + 4
    whole = best_fit.sequences(best_fit.pack_documents(docs, path, 128)).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(map(len, ids)) and all(len(r["ids"]) == 2 * r["n_tokens"] for r in whole)
    assert best_fit.pack_documents(none, path).count() == 0


def test_open_bins_against_plain_best_fit():
    r = np.random.default_rng(3)
    bins, rooms, open_ = best_fit.OpenBins(50, 5), [], []
    for size in r.integers(1, 51, 2000).tolist():
        number, offset = bins.place(size)
        fit = [rooms[i] for i in open_ if rooms[i] >= size]
        if fit:
            assert number in open_ and rooms[number] == min(fit) == 50 - offset
        else:
            if len(open_) == 5:
                closed = (set(open_) - set(bins.open_numbers())).pop()
                assert rooms[closed] == min(rooms[i] for i in open_)
                open_.remove(closed)
            assert number == len(rooms) and offset == 0
            rooms.append(50)
            open_.append(number)
        rooms[number] -= size
        if not rooms[number]:
            open_.remove(number)
        assert sorted(open_) == sorted(bins.open_numbers())
