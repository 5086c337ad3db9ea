"""The five stages on a small corpus with a known outcome, and rows that must not get lost or spoiled."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tideglass.llm.common import is_held_out
from tideglass.llm.decontamination import decontaminate, leaks
from tideglass.llm.near_duplicates import unique_documents
from tideglass.llm.substring_dedup import with_repeats, without_repeats


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 30_000, n))


def test_one_row_of_each_group_stays_whole(spark):
    rng = np.random.default_rng(0)
    a, b, c = (words(rng, 80) for _ in range(3))
    near = a.replace(a.split()[40], "edit", 1)
    rows = [(1, a, 7, "k"), (1, b, 7, "k"), (2, near, 8, "k"), (None, c, 9, "k"), (None, c, 9, "k"), (None, c, 5, "z"), (3, "", 1, "k"), (3, "", 1, "k"), (4, None, 1, "k"), (5, "one", 2, "k"), (None, "one", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, kept_id string").withColumn("row", F.lit(1)).withColumn("mark", F.lit("m"))
    got = sorted((tuple(r)[:3] for r in unique_documents(df).collect()), key=str)
    of_c = [r for r in got if r[1] == c]
    assert len(of_c) == 1 and of_c[0][2] in (5, 9)
    assert sorted((r for r in got if r[1] != c), key=str) == sorted([(1, a, 7), (1, b, 7), (3, "", 1), (3, "", 1), (4, None, 1), (5, "one", 2)], key=str)
    assert unique_documents(df).columns == df.columns and unique_documents(df.limit(0)).count() == 0


def test_rows_leak_by_their_text(spark):
    rng = np.random.default_rng(1)
    item = words(rng, 30)
    rows = [(None, "clean words here", 1), (None, words(rng, 20) + " " + item, 2), (1, words(rng, 50), 3), (1, item, 4), (2, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaking_id int").withColumn("key", F.lit(0))
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = decontaminate(df, items)
    assert sorted(r.leaking_id for r in out.collect()) == [1, 3, 5] and out.columns == df.columns


def test_items_of_one_or_two_words(spark):
    items = spark.createDataFrame([(0, "alpha beta"), (1, "gamma"), (2, "one two three four")], "item_id long, text string")
    rows = [(0, "alpha beta"), (1, "here is alpha beta inside a text"), (2, "alpha x beta"), (3, "all gamma rays"), (4, "gammas"), (5, "x one two three four y"), (6, "alpha"), (7, "gamma")]
    found = leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 0), (3, 1), (7, 1), (5, 2)}
    place = next(r for r in found if r.doc_id == 1)
    assert rows[1][1][place.start : place.end] == "alpha beta" and place.score == 1.0


def test_repeats_beside_columns_of_the_same_name(spark):
    passage = "p" * 300 + "q" * 300
    df = spark.createDataFrame([(1, "a" + passage, 1, 2), (2, "b" + passage, 3, 4)], "doc_id long, text string, own_key int, own_spans int").withColumn("row", F.lit(5))
    got = {r.doc_id: r for r in with_repeats(df).collect()}
    assert got[1].own_key == 1 and got[2].own_spans == 4 and got[1].spans[0].start == 1 and got[1].row == 5
    assert {r.text for r in without_repeats(df).collect()} == {"a", "b"} and without_repeats(df).columns == df.columns


def without_windows(rows, size=400):
    """Texts (ASCII) without the characters that a repeated window covers, by counting every window."""
    counts = Counter(t[k : k + size] for _, t in rows if t for k in range(len(t) - size + 1))
    out = set()
    for i, t in rows:
        hit = [k for k in range(len(t or "") - size + 1) if counts[t[k : k + size]] > 1]
        gone = {c for k in hit for c in range(k, k + size)}
        out.add((i, t and "".join(c for k, c in enumerate(t) if k not in gone)))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    item, passage = words(rng, 40), words(rng, 120)
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, words(rng, 60) + (" grumblestink vilemuck" if bad else "")))
        labels.append((i, 1, int(bad)))
    shared = words(rng, 300)
    rows += [(300 + k, shared.replace(shared.split()[10 * k], "edit", 1)) for k in range(4)]
    rows += [(400 + k, words(rng, 60) + "\n" + passage + "\n" + words(rng, 60)) for k in range(3)]
    rows += [(500, words(rng, 40) + " " + item), (None, words(rng, 50)), (None, words(rng, 50)), (600, None), (601, "")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, own_key int").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return rows, passage, str(path)


def test_stages(spark, corpus):
    rows, passage, path = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.schema == spark.read.parquet(f"{path}/documents.parquet").schema
        seen.append({(r.doc_id, r.text) for r in docs.collect()})
    bad = {i for i in range(240) if i % 6 == 0}
    clean = {(i, t) for i, t in rows if i not in bad}
    assert seen[0] == clean and any(is_held_out(i) for i in bad)
    clean -= {(i, t) for i, t in rows if i in (301, 302, 303)}
    assert seen[1] == clean
    cut = without_windows(clean)
    assert seen[2] == cut and not any(passage[:390] in (t or "") for _, t in cut)
    cut = {(i, t) for i, t in cut if i != 500}
    assert seen[3] == cut
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    packed = corpus_pipeline.run(spark, path).collect()
    size = {r.doc_id: 0 for r in packed}
    for r in packed:
        size[r.doc_id] += r.length
    counts = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in cut if i is not None}
    assert {i: n for i, n in size.items() if i is not None} == counts
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    ends = {}
    for s, offset, n in places:
        assert offset == ends.get(s, 0) and offset + n <= 4_096
        ends[s] = offset + n
    total = sum(ends.values())
    assert len(ends) == -(-total // 4_096)
