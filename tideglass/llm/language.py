"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams cover all training texts. The regression is fitted by follow-the-regularised-
leader with elastic-net penalties on a bounded sample of them (``PER_LANGUAGE`` rows of a language, drawn by hash), a
part of which is kept back to calibrate a temperature. Every whole text is scored where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import text_blocks
from tideglass.llm.ngrams import code_points, hashed

#: Bounds of the sample: rows of a language, and languages (the most frequent ones).
PER_LANGUAGE = 1_500
LANGUAGES = 256
ORDERS = (1, 2, 3)
BITS = 15
EPOCHS = 3
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
SCALE = 20.0


@dataclass
class LanguageModel:
    """``weights[f, c]`` includes idf and scale; row 2^BITS is zero. Scores are softmax((x w + bias) / temperature)."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((1 << BITS) + 1, np.int64), 0
    seen = np.zeros((1 << BITS) + 1, bool)
    for batch in text_blocks(batches, "text"):
        points, first = code_points(batch.column("text").to_pylist())
        grams = hashed(points, first, ORDERS, BITS)
        for a, b in zip(first[:-1], first[1:], strict=True):
            for x in grams:
                seen[x[a:b]] = True
            total += seen
            seen[:] = False
        n += batch.num_rows
    total[-1] = n  # the last place holds the number of texts
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["gram", "n"])


def _features(texts: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    points, first = code_points(texts)
    grams = hashed(points, first, ORDERS, BITS)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        at, n = np.unique(np.concatenate([x[a:b] for x in grams]), return_counts=True)
        at, n = (at[:-1], n[:-1]) if len(at) and at[-1] == 1 << BITS else (at, n)
        out.append((at, n / max(1, n.sum())))
    return out, first


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes; most weights are exactly zero."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)  # the last row serves as the bias
            own_z, own_n = z[at], n[at]
            w = weight(own_z, own_n)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] = own_z + g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha * w
            n[at] = own_n + g * g
    w = weight(z, n)
    return w[:-1], w[-1]


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section between 0.05 and 20."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    if not len(scores):
        return 1.0
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on the rows of ``docs`` where ``usable`` holds and text and language are there.

    Null or empty texts and null languages teach nothing. Without any training row the model has no classes.
    """
    train = docs.where(usable).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and length(text) > 0")
    counts = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return LanguageModel([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0), 1.0)
    df = train.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 2^BITS + 1 rows
    seen = np.zeros((1 << BITS) + 1)
    seen[df["gram"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    names = sorted(r.lang for r in counts)
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, per_language / r.n)))])
    # A share drawn by hash keeps about per_language rows of each language; the limit is the hard bound.
    drawn = train.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("text", "lang").limit(2 * per_language * len(names))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("text", "ascending")])
        labels = np.array([names.index(x) for x in table["lang"].to_pylist()])
        rows = []
        for batch in text_blocks(iter(table.to_batches()), "text", 1_000_000):
            rows += [(at, x * idf[at] * SCALE) for at, x in _features(batch.column("text").to_pylist())[0]]
        back = np.arange(len(rows)) % 5 == 0
        w, b = train_ftrl([r for r, out in zip(rows, back, strict=True) if not out], labels[~back], len(names))
        scores = np.array([x @ w[at] + b for (at, x), out in zip(rows, back, strict=True) if out]).reshape(-1, len(names))
        heat = calibrate(scores, labels[back])
        full = np.concatenate((w * idf[:, None] * SCALE, np.zeros((1, len(names))))).astype("<f4")
        return pa.table([pa.array([full.tobytes()], pa.binary()), pa.array([b.astype("<f8").tobytes()], pa.binary()), pa.array([heat])], names=["w", "b", "heat"])

    got = drawn.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(fit, "w binary, b binary, heat double").first()
    return LanguageModel(names, np.frombuffer(got.w, "<f4").reshape(-1, len(names)), np.frombuffer(got.b, "<f8"), got.heat)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` with score 0 for null texts and texts without a letter.

    Without learned classes every text is ``und``. Ties take the first name in alphabetical order.
    """
    names = model.names
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.weights.T), model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, heat = shared.value
        for batch in text_blocks(batches, "text"):
            texts = batch.column("text").to_pylist()
            known = np.array([bool(names) and t is not None and LETTER.search(t) is not None for t in texts])
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            if known.any():
                points, first = code_points(texts)
                total, windows = np.zeros((len(names), len(texts))), np.zeros(len(texts))
                for order, x in zip(ORDERS, hashed(points, first, ORDERS, BITS), strict=True):
                    windows += np.maximum(0, np.diff(first) - order + 1)
                    for c, w in enumerate(weights):
                        total[c] += np.add.reduceat(w[x], first[:-1], dtype=np.float64)
                s = (total / np.maximum(1, windows) + bias[:, None]) / heat
                p = np.exp(s - s.max(axis=0))
                p /= p.sum(axis=0)
                best, score = p.argmax(axis=0), p.max(axis=0)
            out = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")
