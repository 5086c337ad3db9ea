"""Toxicity of texts: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, drawn by a hash of the id. In tasks, every n-gram that a
text has is counted once by label; the ratios above 0 with the largest z-values are kept as features, and a logistic
regression on ratio times presence is trained on them. Every whole text is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import bound_batches, give_back, held_out, kept_table, text_blocks
from tideglass.llm.ngrams import code_points, hashed

#: Bound of the labelled rows the model is fitted on.
TRAIN_ROWS = 30_000
ORDERS = (4, 5, 6)
BITS = 20
FEATURES = 3_000
THRESHOLD = 0.3
#: Bytes of text whose n-grams are held together, unless one text is longer: all of them when counting, few when scoring.
COUNT_BYTES, SCORE_BYTES = 250_000, 500_000
#: Hashed n-grams whose counts leave a task together.
SENT = 1 << 16


@dataclass
class ToxicModel:
    """``weights`` of the hashed n-grams (ratio times coefficient, 0 for most) and the intercept."""

    weights: np.ndarray
    bias: float


def _present(texts: list, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, n-gram) that occur, each once; only n-grams marked in ``known`` if given."""
    points, first = code_points(texts)
    found = []
    for x in hashed(points, first, ORDERS, BITS):
        at = np.flatnonzero(x < (1 << BITS) if known is None else known[x])
        docs = np.searchsorted(first, at, side="right") - 1
        found.append(np.unique((docs << np.int64(BITS)) | x[at]))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in text_blocks(batches, "text", COUNT_BYTES):
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        docs, grams = _present(batch.column("text").to_pylist(), None)
        for y in (0, 1):
            counts[y] += np.bincount(grams[labels[docs] == y], minlength=1 << BITS)
    for start in range(0, 1 << BITS, SENT):
        part = counts[:, start : start + SENT]
        at = np.flatnonzero(part.any(axis=0))
        yield pa.record_batch([pa.array(at + start), pa.array(part[0][at]), pa.array(part[1][at])], ["gram", "n0", "n1"])
    # The worker lives on: its counts go before the memory is given back.
    counts = part = batch = None
    give_back()


def _fit(rows: list[np.ndarray], labels: np.ndarray, size: int, steps: int = 300, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows ``(index, value)`` by accelerated gradient steps."""
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, b, prior = np.zeros(size), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), 0.0
    # The step follows from the largest eigenvalue of the second moments, intercept included.
    v, v_b, top = np.ones(size), 1.0, 1.0
    for _ in range(30):
        u = np.bincount(row, value * v[at], len(rows)) + v_b
        v, v_b = np.bincount(at, value * u[row], size) / len(rows), u.mean()
        top = np.sqrt(v @ v + v_b * v_b)
        v, v_b = v / top, v_b / top
    look, look_b, rate = w, b, 1 / (0.25 * 1.1 * top + ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * look[at], len(rows)) + look_b, -30, 30)))
        e = (p - labels) / len(labels)
        new, new_b = look - rate * (np.bincount(at, value * e[row], size) + ridge / len(labels) * look), look_b - rate * e.sum()
        ahead = (1 + np.sqrt(1 + 4 * prior**2)) / 2
        share = max(0.0, (prior - 1) / ahead)
        look, look_b = new + share * (new - w), new_b + share * (new_b - b)
        w, b, prior = new, new_b, ahead
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Fit on rows of ``docs (doc_id, text)`` labelled in ``labels (doc_id, toxic)``; held-out ids are never used.

    Null ids, labels other than 0 and 1 and ids with both labels teach nothing. Without labels of both kinds the model
    has no features and scores every text with the share of toxic rows (0.5 without any).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    drawn = one.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(train_rows)
    # At most train_rows rows of two numbers: a broadcast of bounded size, and the texts stay where they are.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").where("text is not null")
    train = kept_table(texts.select("text", "label"), "labelled")
    n1, n = train.agg(F.sum("label"), F.count("*")).first()
    if not n or not n1 or n1 == n:
        share = (n1 or 0) / n if n else 0.5
        return ToxicModel(np.zeros((1 << BITS) + 1, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    a, b = F.col("p") / F.lit(float(n1 + 2)), F.col("q") / F.lit(float(n - n1 + 2))
    counts = train.mapInArrow(_count, "gram long, n0 long, n1 long").groupBy("gram").agg((F.sum("n1") + 1.0).alias("p"), (F.sum("n0") + 1.0).alias("q"))
    ratio = counts.where("p + q > 4").where(a > b).select("gram", F.log(a / b).alias("r"), (F.log(a / b) / F.sqrt(1 / F.col("p") + 1 / F.col("q"))).alias("z"))
    best = ratio.orderBy(F.desc("z"), "gram").limit(FEATURES).collect()
    grams = np.array([r.gram for r in best], np.int64)
    ratios = np.array([r.r for r in best])
    place = np.full((1 << BITS) + 1, -1, np.int32)
    place[grams] = np.arange(len(grams))
    shared = spark.sparkContext.broadcast(place)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_blocks(batches, "text", COUNT_BYTES):
            docs, found = _present(batch.column("text").to_pylist(), own >= 0)
            cuts = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column("label"), pa.array([own[found[a:b]].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["label", "at"])

    held = train.mapInArrow(rows, "label int, at binary").collect()  # at most train_rows rows, of few bytes each
    w, b = _fit([(x, ratios[x]) for x in (np.frombuffer(r.at, "<i4") for r in held)], np.array([float(r.label) for r in held]), len(grams))
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[grams] = w * ratios
    return ToxicModel(weights, b)


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1); null and empty texts get the score of no n-gram at all.

    All columns of ``docs`` stay, repeated rows too; a column ``toxicity`` of its own is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    at = np.flatnonzero(model.weights)
    shared, bias = spark.sparkContext.broadcast((at, model.weights[at])), model.bias
    docs = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = values
        for batch in text_blocks(batches, "text", SCORE_BYTES):
            docs, found = _present(batch.column("text").to_pylist(), weights != 0)
            total = np.bincount(docs, weights[found], batch.num_rows) + bias
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], [*batch.schema.names, "toxicity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, toxicity double")
