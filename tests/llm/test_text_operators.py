import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tideglass.llm import near_duplicates as near_module
from tideglass.llm import packing
from tideglass.llm.decontamination import best_alignment, decontaminate, leaks
from tideglass.llm.near_duplicates import near_duplicates
from tideglass.llm.packing import best_fit, bins_needed, document_pieces, pack
from tideglass.llm.substring_dedup import repeat_digests, repeated_windows, with_repeats, without_repeats
from tideglass.llm.suffix_sort import suffix_array
from tideglass.llm.token_counts import count_tokens

ODD = ["", None, " ", "\n", "a", " a  b\tc \n d", "x<|endoftext|>y <|endoftext|>", "<|STARTOFTEXT|> <|startoftext|>", "it's  we'll ok é ÀÉ ß", "日本語 text\x1cq", "word " * 3_000, "z" * 5_000, "12 345 !?.,;"]


def words(rng, n, size=400):
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


def test_token_counts(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "a"), (None, "b c"), (None, "b c"), (3, "other text")]
    want = sorted(((-1 if i is None else i), len((t or "").encode()), len(known.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(documents(rows), path).collect())
    assert got == want
    assert count_tokens(documents([]), path).count() == 0


def test_packing_brings_pieces_back(monkeypatch):
    """Pieces that left the younger half give the same ids when they come back."""
    monkeypatch.setattr(packing, "HELD_WORDS", 0)
    monkeypatch.setattr(packing, "HELD_PIECES", 6)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two. three, 4x", "five six! seven,", "Two Three. ONE?", "eight nine ten. 4x", "one. two three ten"]
    for text in texts * 3:
        known = encoder.learn(set(text.split(" ")))
        assert b"".join(known[w] for w in text.split(" ")) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_holds_a_bounded_table():
    """Of words that come once, a task holds the last ones only, and their ids are right."""
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghij"
    for step in range(40):
        stems = ["x" + "".join(letters[int(c)] for c in f"{i:05d}") for i in range(step * 1_000, (step + 1) * 1_000)]
        words = {s + tail for s in stems for tail in ("", ".", ",", ";", ":", "!", "?", "*", "#", "%")}
        known = encoder.learn(words)
        assert words <= known.keys()
        for word in sorted(words)[::1_999]:
            assert np.frombuffer(known[word], "<u4").tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids
    assert sum(len(v) for v in vars(encoder).values() if isinstance(v, dict)) < 200_000


def test_packing(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    rng = np.random.default_rng(0)
    rows = [(i, t) for i, t in enumerate([*ODD, *(words(rng, int(n)) for n in rng.integers(1, 3_000, 60))])] + [(4, "a")]
    out = pack(document_pieces(documents(rows), path), per_task=20).collect()
    want = []
    for i, t in rows:
        ids = np.array(known.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096
    # Twenty pieces a task are far fewer than in earnest; together they meet the bound.
    needed = bins_needed(np.array([r.length for r in out]))
    assert len(bins) <= 1.05 * needed + 1
    assert pack(document_pieces(documents(rows), path)).select("sequence_id").distinct().count() <= needed + 1
    assert pack(document_pieces(documents([]), path)).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    """Words in turn, with a table so small that words leave it and come back."""
    monkeypatch.setattr(packing, "HELD_WORDS", 40)
    monkeypatch.setattr(packing, "JOINED", 7)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    letters, tails = list("aeiounrstlhAEéßñÑ"), ["", "", "", ".", ",", "***", "!!", "'s", "7"]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 12))) + tails[rng.integers(0, len(tails))] for _ in range(30)) for _ in range(30)]
    texts += [t for t in ODD if t and "<|STARTOFTEXT" not in t] + ["don't it's we'll 's O'Neil's.", "x\u0130y \u0130. \u00c9cole. \u03a3\u03a3 o\u03a3.", "a.,b ..a, 12ab. ab12. \u00aa\u00ba. \u0149a, \u01c5! \u017f.", "<|endoftext|>. a<|startoftext|>!", "\x1c a\x1fb, c. \u0085e e\u0301. e\u0301"]
    for text in texts * 2:
        parts = text.split(" ")
        known = encoder.learn(set(parts))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert b"".join(known[w] for w in parts) == b"".join(i.to_bytes(4, "little") for i in want), text[:80]


def test_words_are_cut_as_the_library_reads_them(monkeypatch):
    """Texts of one block: a word is learned once whatever sign follows it, and the ids are those of the whole text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    asked, learn = set(), packing.Encoder.learn
    monkeypatch.setattr(packing.Encoder, "learn", lambda self, words: asked.update(words) or learn(self, words))
    plain = ["harbour, harbour. harbour; Harbour: harbour! harbour?\nharbour", "Harbour.", "12, 12."]
    odd = [t for t in ODD] + [
        None, "", " ", ".", "...", "a.. b.,", ". a", "'s. 'l. it's, \u00e9l\u00e8ve. \u00d7. \u00f7, \u00ff! \u00aa; \u00b5: \u00b2.", "\u0130. \u03a3\u03a3. E\u0301. e\u0301, H\u0331. I\u0307, A \u0301.",
        "<|ENDOFTEXT|> A. <|endoftext|>. B, <|startoftext|>", "A\tb.\r\nC,\x0bD.\x0cE", "\u00a0A. \u0085b, \u2003c. \u4e2d. \U0001f600, x\U0001f600. y", "\u00c3. \u0103. \u0103", "A", "\u0301a. b",
    ]
    for texts in (plain, odd, plain + odd):
        rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        got = pa.Table.from_batches(packing._pieces(path, 1, 4096)(iter([rows.slice(1), rows]))).to_pylist()[len(texts) - 1 :]
        want = [[*known.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert [r["length"] for r in got] == [len(w) for w in want]
        assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
        if texts is plain:
            assert asked == {"harbour", ",", ".", ";", ":", "!", "?", "12"}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        x = rng.integers(1, 101, n)
        where, left = best_fit(x, 100)
        fill = np.bincount(where, x)
        assert fill.max() <= 100 and (100 - fill[where] == left).all()
        assert -(-x.sum() // 100) <= bins_needed(x, 100) <= len(fill)
    assert bins_needed(np.array([51, 51, 51]), 100) == 3
    assert bins_needed(np.array([34] * 6), 100) == 3


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((v for v in g if v is not None), default=None) for k, g in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


def test_large_buckets_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(near_module, "BLOCK_ROWS", 40, raising=False)
    rng = np.random.default_rng(8)
    base, rows = words(rng, 120, 5_000).split(), []
    # A template whose copies are mostly not similar enough to each other.
    for k in range(400):
        copy = list(base)
        for at in rng.choice(len(copy), 3, replace=False):
            copy[at] = f"edit{k}x{at}"
        rows.append((len(rows), " ".join(copy)))
    want = components_of(rows)
    got = near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_near_duplicates_equal_brute_force(spark, documents):
    rng = np.random.default_rng(2)
    rows, passage = [], words(rng, 40)
    for g in range(12):
        base = words(rng, 120, 5_000).split()
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[at] = "edit" + str(rng.integers(0, 9_999))
            rows.append((len(rows), " ".join(copy).upper() if g % 2 else " ".join(copy)))
    rows += [(len(rows) + i, words(rng, 30, 5_000) + " " + passage) for i in range(20)]
    rows += [(len(rows) + i, t) for i, t in enumerate(ODD)] + [(900 + i, "same short text") for i in range(5)] + [(7, rows[7][1]), (None, rows[3][1])]
    got = near_duplicates(documents(rows)).collect()
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(components_of(rows), key=order)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(documents([])).count() == 0
    assert [(r.component_id, r.kept) for r in near_duplicates(documents([(3, None)])).collect()] == [(3, True)]


@pytest.mark.parametrize("memory_rows", [4, 1_000_000])
def test_suffix_array(memory_rows):
    rng = np.random.default_rng(3)
    for t in range(150):
        x = (rng.integers(0, 1 + t % 5, int(rng.integers(1, 70))) + 97).astype(np.uint8)
        raw = bytes(np.tile(x, 1 + t % 3))
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            common.append(k)
        places, values = suffix_array(np.frombuffer(raw, np.uint8), memory_rows)
        assert places.tolist() == order and values.tolist() == common


def removed(texts, window):
    seen, spans = {}, []
    for t in texts:
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]] = seen.get(t[p : p + window], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\x01" * window
        spans.append(gone)
    return spans


@pytest.mark.parametrize("hot", [0, 6_000])
def test_repeats_equal_brute_force(spark, documents, monkeypatch, hot):
    import tideglass.llm.substring_dedup as s

    monkeypatch.setattr(s, "HOT_SEGMENTS", hot)
    rng = np.random.default_rng(4)
    passage, long = words(rng, 120, 9_000), words(rng, 400, 9_000)
    texts = [words(rng, 100, 9_000) + " " + passage + " é" * int(k) + words(rng, 30, 9_000) for k in rng.integers(0, 9, 12)]
    texts += [long, long + "x", long, "é" * 900, "ab" * 500, passage[:405], passage[5:], words(rng, 300), *ODD]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[20])]
    raws = [(t or "").encode() for _, t in rows]
    gone = removed(raws, 400)
    want = sorted(
        ((-1 if i is None else i), len(r), sum(g), len(re.findall(b"\x01+", bytes(g))), hashlib.sha256(bytes(b for b, x in zip(r, g) if not x)).hexdigest())
        for (i, _), r, g in zip(rows, raws, gone)
    )
    got = repeat_digests(with_repeats(documents(rows))).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    cut = without_repeats(documents(rows))
    assert cut.columns == documents([]).columns and cut.count() == len(rows)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[0].encode() == bytes(b for b, x in zip(raws[0], gone[0]) if not x)
    assert repeat_digests(with_repeats(documents([]))).count() == 0


def test_repeats_hold_little_memory_at_once():
    import tracemalloc

    import pyarrow as pa
    import tideglass.llm.substring_dedup as s

    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, 250_000, dtype=np.uint8)).decode() for _ in range(12)]
    docs = pa.record_batch([pa.array([b"k%d" % i for i in range(12)]), pa.array(texts)], ["tkey", "text"])
    segments = [t[a : a + 600].encode() for t in texts for a in range(0, 249_000, 600)]
    ids = [b"%d" % i for i in range(len(segments))]
    rows = pa.record_batch([pa.array(range(len(segments))), pa.array(ids), pa.array(segments)], ["anchor", "sid", "segment"])
    peaks = []
    for step, batch in ((s._anchors(400), docs), (s._sort_blocks(400), rows)):
        tracemalloc.start()
        assert sum(b.num_rows >= 0 for b in step(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 80 and peaks[1] < 220, peaks


def test_repeated_windows_in_segments():
    x = repeated_windows([b"abcdefgh", b"zzcdefzz", b"bcdefg"], 4)
    assert [v.tolist() for v in x] == [[1, 2, 3], [2], [0, 1, 2]]


def test_leaks(spark, documents):
    rng = np.random.default_rng(5)
    items = [(k, words(rng, 30, 20_000)) for k in range(8)] + [(8, None), (9, ""), (10, "two words"), (11, None)]
    items[11] = (11, items[0][1])
    table = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].split()
    for k in range(3, 30, 6):
        edited[k] = "changed"
    rows = [(k, words(rng, 200, 20_000)) for k in range(30)]
    rows[3] = (3, words(rng, 50, 20_000) + " é " + items[0][1] + " " + words(rng, 50, 20_000))
    rows[4] = (4, words(rng, 500, 20_000) + "\n" + " ".join(edited).upper())
    rows += [(100 + k, words(rng, 20, 20_000) + " " + items[2][1]) for k in range(40)] + [(3, rows[3][1]), (None, items[3][1])]
    rows += [(200 + k, t) for k, t in enumerate(ODD)]
    found = leaks(documents(rows), table).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == {(3, 0), (3, 11), (4, 1), (None, 3), *((100 + k, 2) for k in range(40))} and len(found) == len(got)
    one = next(r for r in found if (r.doc_id, r.item_id) == (3, 0))
    assert one.score == 1.0 and rows[3][1].encode()[one.start : one.end].decode() == items[0][1]
    clean = decontaminate(documents(rows), table)
    assert clean.columns == documents([]).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert leaks(documents([]), table).count() == 0 and leaks(documents(rows), table.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [0, 1, 3])
def test_leaks_of_frequent_variants(spark, documents, whole):
    rng = np.random.default_rng(11)
    item = words(rng, 20, 20_000)
    edited = item.split()
    edited[4::5] = ["changed"] * len(edited[4::5])
    rows = [(k, words(rng, 60, 20_000) + " " + " ".join(edited) + " " + words(rng, 60, 20_000)) for k in range(40)]
    rows += [(200 + k, words(rng, 60, 20_000) + " " + item) for k in range(whole)]
    # One seed of the item in clean documents is no leak.
    rows += [(300 + k, words(rng, 60, 20_000) + " " + " ".join(item.split()[:3]) + " " + words(rng, 60, 20_000)) for k in range(60)]
    found = leaks(documents(rows), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [i for i, _ in rows if i < 300]


def test_alignment_score():
    x = np.array([1, 2, 3, 4, 5])
    assert best_alignment(x, np.array([9, 1, 2, 3, 4, 5, 9])) == (10, 1, 6)
    assert best_alignment(x, np.array([1, 2, 9, 4, 5]))[0] == 7
    assert best_alignment(x, np.array([1, 2, 3, 9, 4, 5]))[0] == 9
    assert best_alignment(x, np.array([1, 2, 4, 5]))[0] == 7
