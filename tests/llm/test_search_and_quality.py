import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import cover_tree, quality
from tideglass.llm.common import is_held_out
from tideglass.llm.hard_negatives import hard_negatives
from tideglass.llm.ranked_search import Corpus, Inverted, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranks(docs, items, k=10):
    """The same ranks by looking at every document for every item."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, size = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = set()
    for item, own in asked.items():
        rows = []
        for doc, t in held:
            m = 25 + (75 * len(t) * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in own if x in df)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(rows)[:k], 1):
            out.add((item, rank, doc, -s))
    return out


def texts(rng, n, words=60):
    names = [f"w{i}" for i in range(words)] + ["ÜBER", "naïve", "X9"]
    share = 1 / np.arange(1, len(names) + 1)
    return [rng.choice([" ", "-", "\n", "."]).join(rng.choice(names, int(rng.integers(1, 40)), p=share / share.sum())) for _ in range(n)]


@pytest.mark.parametrize("block_pairs", [1 << 18, 20])
def test_ranks_equal_brute_force(spark, block_pairs):
    rng = np.random.default_rng(4)
    docs = list(enumerate(texts(rng, 300)))
    # Ties, repeated rows, null ids and texts, texts without a term, very long texts.
    docs += [(900, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (901, None), (902, ""), (903, " .,-"), (904, "w1 " * 30_000 + "w50")]
    items = list(enumerate(texts(rng, 12))) + [(100, None), (101, "!!"), (102, "unheard"), (3, "w2 w2"), (None, "w40 w41")]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in ranked_search(d, q, block_pairs=block_pairs).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_ranks(docs, items)


def test_ranks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0
    assert ranked_search(d.withColumn("text", F.lit(None).cast("string")), q).count() == 0


def test_accumulators_stop_and_scores_stay_whole():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(30) < np.linspace(0.01, 0.9, 30)) for _ in range(2_000)]
    raw = lambda x: np.asarray(x).astype("<i4").tobytes()
    batch = pa.record_batch([pa.array([20] * 2_000, pa.int64()), pa.array([raw(r) for r in rows]), pa.array([raw(np.ones(len(r))) for r in rows])], ["n", "terms", "tf"])
    corpus = Corpus(2_000, 40_000, np.bincount(np.concatenate(rows), minlength=30))
    block, order, weight = Inverted(batch, corpus), np.argsort(corpus.df), corpus.weights()
    at, score = block.search(order, weight[order], 10, 0)
    full = np.array([sum(weight[t] * (10**9 // (1000 + 8 * 100)) for t in r) for r in rows])
    assert (score == full[at]).all() and set(np.flatnonzero(full >= np.sort(full)[-10])) == set(at)
    few, _ = block.search(order, weight[order], 10, int(np.sort(full)[-3]))
    assert set(few) == set(np.flatnonzero(full >= np.sort(full)[-3]))


@pytest.mark.parametrize("n,dim,copies", [(700, 3, False), (400, 16, False), (300, 2, True), (1, 4, False)])
def test_cover_tree_bounds_hold(n, dim, copies):
    rng = np.random.default_rng(n)
    x = np.floor(256 * rng.normal(size=(n, dim)))
    if copies:
        x = x[rng.integers(0, 20, n)]
    reach = float(np.sqrt((x * x).sum(axis=1).max()))
    tree, order = cover_tree.build(x, reach)
    assert sorted(order) == list(range(n)) and (tree.points == x[order]).all()

    def held(node):
        (a, b), (c, d) = tree.own[node], tree.below[node]
        return np.concatenate([np.arange(a, b), *[held(k) for k in range(c, d)]])

    for q in x[:5]:
        length = float(np.sqrt(q @ q))
        low, high = cover_tree.bounds(tree, np.arange(len(tree.own)), q, length)
        for node in range(len(tree.own)):
            s = tree.points[held(node).astype(int)] @ q
            assert low[node] <= s.min() and s.max() <= high[node]


def plain_negatives(rows, anchor):
    kept = sorted({(i, y, tuple(math.floor(256 * c) for c in v)) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for i, y, v in kept:
        if not anchor(i):
            continue
        same = sorted((-dot(v, w), j) for j, z, w in kept if z == y and j != i and len(w) == len(v))[:5]
        for s, j in same:
            other = sorted((-dot(v, w), k) for k, z, w in kept if z != y and len(w) == len(v) and 50 * -s <= 100 * dot(v, w) <= 95 * -s)[:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(other, 1)]
    return sorted(out)


@pytest.mark.parametrize("tree_rows,anchor_bytes", [(2_048, 32_000_000), (40, 2_000)])
def test_negatives_equal_brute_force(spark, tree_rows, anchor_bytes):
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(6, 8)) * 0.3
    rows = [(i, int(rng.integers(0, 3)), (heads[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    rows += [(1_000 + i, i % 3, rows[0][2]) for i in range(60)]  # a large group of equal vectors
    rows += [rows[10], rows[10], (10, 1, rows[11][2]), (20, None, rows[1][2]), (30, 1, None), (40, 1, []), (50, 1, [0.1] * 7 + [None]), (60, 2, [math.nan] + [0.1] * 7), (70, 1, [math.inf] * 8)]
    rows += [(None, 1, rows[2][2]), (80, 1, [0.5, 0.5]), (81, 1, [0.5, 0.4]), (82, 2, [0.3, 0.4]), (90, 1, [0.0] * 8)]
    df = spark.createDataFrame([(i, y, v, 3) for i, y, v in rows], "vec_id long, label int, embedding array<double>, rank int")
    out = hard_negatives(df, F.col("vec_id") % 10 == 0, tree_rows=tree_rows, anchor_bytes=anchor_bytes)
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 200
    assert hard_negatives(df.limit(0), F.lit(True)).count() == 0 and hard_negatives(df, F.lit(False)).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(7)
    words = "kalo mire duna pesh tori schnurz glopf".split()
    speech = lambda end, n=50: " ".join(w + end for w in rng.choice(words, n))
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        text = [speech("%%%"), " ".join([rng.choice(words)] * 60), speech("!!").upper()][i // 4 % 3] if bad else speech("")
        rows.append((i, text, "own", 1.0))
        labels.append((i, int(not bad)))
    odd = ["", None, " \n", "x", "word " * 50_000]
    rows += [(1_000 + k, t, "own", 1.0) for k, t in enumerate(odd)] + [(None, "kalo mire", "own", 1.0), rows[1]]
    labels += [(None, 0), (2_000, 1), (1_003, 1), (1_003, 0), (1_002, None), (1_001, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality_score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit_quality(docs, marks)
    assert 0 < (model.weights != 0).sum() < 2_000
    scored = quality.score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "quality_score"]
    out = scored.collect()
    assert len(out) == len(rows) and all(0 <= r.quality_score <= 1 for r in out)
    got = {r.doc_id: r.quality_score for r in out}
    wrong = [i for i in range(500) if is_held_out(i) and (got[i] >= quality.THRESHOLD) != (i % 4 != 0)]
    assert not wrong and got[1_000] == got[1_001] == got[1_002]
    again = {r.doc_id: r.quality_score for r in quality.score_quality(docs.repartition(3), quality.fit_quality(docs.repartition(7), marks)).collect()}
    assert again == got


def test_quality_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.quality_score, 3) for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.quality_score > 0.99 for r in quality.score_quality(docs, quality.fit_quality(docs, good)).collect())
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), good)).count() == 0


def test_leader_leaves_noise_at_zero():
    rng = np.random.default_rng(8)
    leader = quality.Leader(502, l1=1.0)
    for k in range(400):
        leader.learn(np.array([k % 2, 2 + int(rng.integers(0, 500))]), np.ones(2), k % 2)
    w = leader.weights(slice(None))
    assert w[0] < 0 < w[1] and (w == 0).mean() > 0.99
