import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideglass.llm import language, language_model, toxicity
from tideglass.llm.chats import maximal_conversations
from tideglass.llm.common import held_out, is_held_out
from tideglass.llm.components import components
from tideglass.llm.vector_duplicates import near_vectors

ODD = ["", None, "  \n", "12345 !?", "word " * 3_000]
SPEECH = {"xx": "kalo mire duna pesh tori", "yy": "schnurz glopf bratz wurm krumpf", "zz": "éàô ùîé çéà ôùé àçî"}


def speech(rng, lang, n=60):
    return " ".join(rng.choice(SPEECH[lang].split(), n))


def test_held_out(spark):
    rows = spark.range(500).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == is_held_out(r.id) for r in rows) and 80 < sum(r.h for r in rows) < 170


def test_language(spark):
    rng = np.random.default_rng(0)
    rows = [(i, speech(rng, lang), lang if i % 7 else None) for i in range(240) for lang in [list(SPEECH)[i % 3]]]
    rows += [(1_000 + k, t, "xx") for k, t in enumerate(ODD)] + [(None, speech(rng, "yy"), "yy")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, ~held_out(F.col("doc_id")))
    out = language.predict_language(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in out}
    assert all(got[i] == list(SPEECH)[i % 3] for i in range(240)) and got[None] == "yy"
    assert [got[1_000 + k] for k in range(4)] == ["und"] * 4
    none = language.fit_language(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict_language(docs.limit(3), none).collect()} == {"und"}


def test_most_weights_are_zero():
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 2 + int(rng.integers(0, 500))]), np.ones(2)) for k in range(300)]
    w, _ = language.train_ftrl(rows, np.arange(300) % 2, 2, l1=0.5)
    assert (w[:2] != 0).all() and (w == 0).mean() > 0.99
    assert abs(language.calibrate(np.array([[2.0, 0.0]] * 100), np.array([0] * 73 + [1] * 27)) - 2.0) < 0.05


def test_toxicity_sends_counts_in_parts():
    """Counts of a task leave it in bounded parts, each n-gram once, and are those of all texts."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 60_000))) for _ in range(6)] + [None, ""]
    labels = np.array([0, 1, 0, 1, 1, 0, 1, 0])
    batch = pa.record_batch([pa.array(texts, pa.string()), pa.array(labels, pa.int32())], ["text", "label"])
    parts = list(toxicity._count(iter([batch.slice(0, 3), batch.slice(3)])))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= toxicity.SENT
    got = pa.Table.from_batches(parts).to_pydict()
    docs, grams = toxicity._present(texts, None)
    want = [np.bincount(grams[labels[docs] == y], minlength=1 << toxicity.BITS) for y in (0, 1)]
    at = np.flatnonzero(want[0] + want[1])
    assert got == {"gram": at.tolist(), "n0": want[0][at].tolist(), "n1": want[1][at].tolist()}


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, speech(rng, "xx") + (" grumblestink" if bad else "") + " " + speech(rng, "xx")))
        labels.append((i, int(bad)))
    rows += [(1_000 + k, t) for k, t in enumerate(ODD)]
    labels += [(None, 1), (2_000, 1), (3, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    out = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= v <= 1 for v in out.values())
    wrong = [i for i in range(400) if is_held_out(i) and (out[i] >= toxicity.THRESHOLD) != (i % 5 == 0)]
    assert not wrong and all(out[1_000 + k] < toxicity.THRESHOLD for k in range(4))
    alone = toxicity.fit_toxicity(docs, marks.where("toxic = 0"))
    assert max(r.toxicity for r in toxicity.score_toxicity(docs, alone).collect()) < 0.1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_language_model(spark):
    rng = np.random.default_rng(3)
    cycle = "one two three four five six seven".split()
    rows = [(i, " ".join(cycle * 20)) for i in range(60)] + [(900, " ".join(rng.permutation(cycle * 20))), (901, None), (902, ""), (903, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = language_model.fit_vocabulary(docs)
    model = language_model.fit_model(docs, known, share=1, rounds=2)
    got = {r.doc_id: r for r in language_model.score_documents(docs, known, model).collect()}
    assert got[0].n_tokens == 140 and got[0].perplexity < 0.5 * got[900].perplexity
    assert (got[901].n_tokens, got[901].log_likelihood, got[901].perplexity) == (0, 0.0, None)
    assert got[903].log_likelihood < 0
    assert language_model.score_documents(docs.limit(0), known, model).count() == 0
    # The probabilities of all symbols in one place sum to one.
    context = np.full((language_model.SYMBOLS, 4), 3)
    total = np.exp(language_model.log_probabilities(model, context, np.arange(language_model.SYMBOLS)).astype(float)).sum()
    assert abs(total - 1) < 1e-4


def test_language_model_learns_from_every_document(spark):
    cycle = " ".join("one two three four five six seven".split() * 20)
    base = spark.createDataFrame([(i, cycle) for i in range(60)], "doc_id long, text string")
    known = language_model.fit_vocabulary(base)
    whole = language_model.flat(language_model.fit_model(base, known))
    for gone in (0, 17, 41, 59):
        assert not np.array_equal(whole, language_model.flat(language_model.fit_model(base.where(f"doc_id <> {gone}"), known)))


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + k) for k in range(1, 300)] + [(5, 5), (7, 3)]
    links = [links[k] for k in rng.permutation(len(links))]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1_000 + k] for k in range(300)}) == 1
    assert got[0] != got[1_000] and len(got) == 501
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    vectors = [v + rng.normal(size=16) * 0.25 for v in centre for _ in range(30)] + list(rng.normal(size=(200, 16)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2_000 + k, rows[7][1]) for k in range(50)] + [(3_000, None), (3_001, [0.0] * 16), (3_002, [float("nan")] + [1.0] * 15), (3_003, [None] + [1.0] * 15), (3_004, []), (3_005, [1.0, 2.0]), (3_006, [2.0, 4.0]), (5, rows[5][1])]
    good = [r for r in rows if r[1] and len(r[1]) == 16 and r[0] < 3_000]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    least = np.array([i for i, _ in good])
    while True:
        new = np.where(near, least[None, :], 10**9).min(axis=1)
        if (new == least).all():
            break
        least = new
    want = sorted((i, int(n), int(c)) for (i, _), n, c in zip(good, near.sum(axis=1) - 1, least))
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows) and out[0].audit_recall >= 0.9
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id < 3_000)
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(want)
    rest = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id >= 3_000}
    assert all(rest[i] == (0, i) for i in range(3_000, 3_005)) and rest[3_005] == rest[3_006] == (1, 3_005)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).count() == 1


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, 0, None, None), (5, 1, "user", ""), (6, 5, "user", "hi"), (6, 9, "assistant", "no"),
        (None, 0, "user", "x"),
    ] + [(7, t, "user", f"t{t}") for t in range(1_200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.part): (r.n_turns, r.copies, r.rendered) for r in maximal_conversations(turns).collect()}
    assert set(got) == {(2, 0), (5, 0), (6, 0), (None, 0), (7, 0), (7, 1), (7, 2)}
    assert got[2, 0] == (3, 2, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n")
    assert got[5, 0][2] == "<|user|>\n\n<|user|>\n\n" and got[7, 0][0] == 1_200
    assert "".join(got[7, k][2] for k in range(3)) == "".join(f"<|user|>\nt{t}\n" for t in range(1_200))
    assert maximal_conversations(turns.limit(0)).count() == 0
