"""Quality of texts: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words and runs of symbols are the tokens; a token that repeats the one before is read as one reserved token. A feature
is the share of an n-gram, by hash, among all n-grams of the text of its length. The model is fitted on at most
``TRAIN_ROWS`` labelled rows, drawn by a hash of the id: their sparse rows pass one task as a stream, once per epoch in
another order, so that its memory does not depend on their number. The penalty leaves most weights at zero; a text's
score is the dot product of its sparse row with them, summed where the text lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import held_out, kept_table, text_blocks
from tideglass.llm.runs import SYMBOLS, split_runs
from tideglass.llm.words import mixed

#: Bound of the labelled rows the model is fitted on.
TRAIN_ROWS = 12_000
EPOCHS = 3
ORDERS = (1, 2, 3)
BITS = 18
SCALE = 20.0
THRESHOLD = 0.7
_PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class QualityModel:
    """``weights`` by hashed n-gram, 0 for most and at the last place, and the intercept."""

    weights: np.ndarray
    bias: float


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order a number below 2^BITS at every token, 2^BITS where the n-gram would leave its text; text bounds."""
    runs = split_runs(texts, SYMBOLS)
    tokens, n = runs.hashes.copy(), len(runs.hashes)
    same = np.zeros(n, bool)
    same[1:] = runs.hashes[1:] == runs.hashes[:-1]
    same[runs.first[:-1][runs.first[:-1] < n]] = False
    tokens[same] = _REPEAT
    padded = np.concatenate((tokens, np.zeros(max(ORDERS), np.uint64)))
    out, total, size = [], np.zeros(n, np.uint64), 0
    for order in ORDERS:
        for k in range(size, order):
            total = total + padded[k : k + n] * _PLACES[k]
        size = order
        x = (mixed(total + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int64)
        for k in range(order - 1):
            at = runs.first[1:] - 1 - k
            x[at[at >= 0]] = 1 << BITS
        out.append(x)
    return out, runs.first


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows of texts: places and values as bytes."""
    for batch in text_blocks(batches, "text", 1_000_000):
        grams, first = _grams(batch.column("text"))
        places, values = [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            at, value = [np.zeros(0, np.int64)], [np.zeros(0)]
            for order, x in zip(ORDERS, grams, strict=True):
                own, n = np.unique(x[a:b], return_counts=True)
                inside = own < 1 << BITS
                at.append(own[inside])
                value.append(n[inside] * (SCALE / max(1, b - a - order + 1)))
            at, back = np.unique(np.concatenate(at), return_inverse=True)
            places.append(at.astype("<i4").tobytes())
            values.append(np.bincount(back, np.concatenate(value), len(at)).astype("<f4").tobytes())
        yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["key", "label", "places", "values"])


class Leader:
    """Follow-the-regularised-leader with elastic-net penalties and a step size per weight."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = x * (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leader = Leader((1 << BITS) + 1)  # the last weight is the intercept
    for batch in batches:
        for label, places, values in zip(*(batch.column(c).to_pylist() for c in ("label", "places", "values")), strict=True):
            at, x = np.frombuffer(places, "<i4"), np.frombuffer(values, "<f4").astype(float)
            leader.learn(np.append(at, 1 << BITS), np.append(x, 1.0), label)
    w = leader.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.record_batch([pa.array(at), pa.array(w[at])], ["place", "weight"])


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on rows of ``docs (doc_id, text)`` labelled in ``labels (doc_id, quality)``; held-out ids are never used.

    Null ids, labels other than 0 and 1 and ids with both labels teach nothing; null texts neither, repeated rows teach
    as often as they are there. Without labels of both kinds the model has no features and scores every text with the
    share of good rows (0.5 without any).
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    drawn = one.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(train_rows)
    # At most train_rows rows of two numbers: a broadcast of bounded size, and the texts stay where they are.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").where("text is not null")
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "label", "text")
    train = kept_table(keyed.mapInArrow(_rows, "key long, label int, places binary, values binary"), "quality-rows")
    n1, n = train.agg(F.sum("label"), F.count("*")).first()
    if not n or not n1 or n1 == n:
        share = (n1 or 0) / n if n else 0.5
        return QualityModel(np.zeros((1 << BITS) + 1), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # One sorted stream through one task: rows are bounded by train_rows, and the sort spills in the JVM.
    epochs = train.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    stream = epochs.repartition(1).sortWithinPartitions("epoch", F.xxhash64("key", "epoch"), "key")
    weights = np.zeros((1 << BITS) + 1)
    for r in stream.select("label", "places", "values").mapInArrow(_train, "place long, weight double").collect():  # at most 2^BITS + 1 rows
        weights[r.place] = r.weight
    bias, weights[-1] = float(weights[-1]), 0.0
    return QualityModel(weights, bias)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: better); texts without a token get the score of no n-gram at all.

    All columns of ``docs`` stay, repeated rows too; a column ``quality_score`` of its own is replaced.
    """
    at = np.flatnonzero(model.weights)
    shared, bias = docs.sparkSession.sparkContext.broadcast((at, model.weights[at])), model.bias
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = values
        for batch in text_blocks(batches, "text"):
            grams, first = _grams(batch.column("text"))
            sizes, total = np.diff(first), np.full(batch.num_rows, bias)
            full = np.flatnonzero(sizes)
            for order, x in zip(ORDERS, grams, strict=True):
                if len(full):
                    total[full] += np.add.reduceat(weights[x], first[full]) * SCALE / np.maximum(1, sizes[full] - order + 1)
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], [*batch.schema.names, "quality_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, quality_score double")
