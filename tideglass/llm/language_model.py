"""Masked pseudo-likelihood of documents: every token predicted from the tokens on both sides.

Words are counted over the corpus. A word's symbol is its rank if it is among the ``VOCABULARY`` most frequent, or
else one of ``SPILL`` symbols by hash. A network looks at the symbols in a window of ``REACH`` tokens on both sides,
the middle left out, and gives the probability of the middle's class (symbols in classes by frequency) and of the
symbol in its class. The different words behind a spill symbol
share it evenly, so every word has a probability.

Training runs in tasks over all documents. Every document teaches once, in the round that its hash draws; models of the
tasks are averaged between rounds, weighted by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import kept_table, text_blocks
from tideglass.llm.words import split_words

VOCABULARY = 1_984
SPILL = 64
#: Symbols in a class; VOCABULARY + SPILL + 1 (the edge of a text) symbols in all.
CLASS_SIZE = 32
REACH = 2
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
#: Rows of a training step at most, and at least if there are so many.
BATCH = 8_192
LEAST_BATCH = 1_024
SYMBOLS = VOCABULARY + SPILL
CLASSES = -(-SYMBOLS // CLASS_SIZE)
EDGE = SYMBOLS
SHAPES = {"embed": (SYMBOLS + 1, WIDTH), "hidden": (2 * REACH * WIDTH, HIDDEN), "hidden_bias": (HIDDEN,), "kind": (HIDDEN, CLASSES), "kind_bias": (CLASSES,), "word": (CLASSES, HIDDEN, CLASS_SIZE), "word_bias": (CLASSES, CLASS_SIZE)}
Model = dict[str, np.ndarray]


def new_model(seed: int = 11) -> Model:
    draw = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k.endswith("bias") else draw.normal(0, 0.3 if k == "embed" else s[-2] ** -0.5, s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Model:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = values[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def windows(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbols around every token, ``2 * REACH`` columns; ``EDGE`` beyond the text."""
    n, doc = len(symbols), np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * REACH), EDGE, np.int32)
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = max(0, -step), n - max(0, step)
        if b > a:
            same = doc[a:b] == doc[a + step : b + step]
            out[a:b, k][same] = symbols[a + step : b + step][same]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def log_probabilities(model: Model, context: np.ndarray, symbols: np.ndarray, step: int = 65_536) -> np.ndarray:
    """Natural log of the probability of each symbol given its context."""
    out = np.empty(len(symbols), np.float32)
    for a in range(0, len(symbols), step):
        c, s = context[a : a + step], symbols[a : a + step]
        h = np.tanh(model["embed"][c].reshape(len(c), -1) @ model["hidden"] + model["hidden_bias"])
        kind, inner = s // CLASS_SIZE, s % CLASS_SIZE
        x = h @ model["kind"] + model["kind_bias"]
        top = x.max(axis=1)
        total = x[np.arange(len(s)), kind] - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[k] : cuts[k + 1]]
            y = h[own] @ model["word"][k] + model["word_bias"][k]
            top = y.max(axis=1)
            total[own] += y[np.arange(len(own)), inner[own]] - top - np.log(np.exp(y - top[:, None]).sum(axis=1))
        out[a : a + step] = total
    return out


def train(model: Model, context: np.ndarray, symbols: np.ndarray, state: Model, rate: float) -> None:
    """One pass of AdaGrad over the rows, in place; ``state`` holds the sums of squares.

    A step takes ``BATCH`` rows, or a twentieth of the rows, but ``LEAST_BATCH`` at least. Rows of a step are ordered
    by class, so that the symbols of a class are rows in a row.
    """

    def move(name: str, grad: np.ndarray, at=...) -> None:
        state[name][at] += grad * grad
        model[name][at] -= rate * grad / np.sqrt(state[name][at] + 1e-6)

    size = min(BATCH, max(LEAST_BATCH, len(symbols) // 20))
    for a in range(0, len(symbols), size):
        order = np.argsort((symbols[a : a + size] // CLASS_SIZE).astype(np.int16), kind="stable")
        c, s = context[a : a + size][order], symbols[a : a + size][order]
        n = len(s)
        e = model["embed"][c].reshape(n, -1)
        h = np.tanh(e @ model["hidden"] + model["hidden_bias"])
        kind, inner = s // CLASS_SIZE, s % CLASS_SIZE
        g = _softmax(h @ model["kind"] + model["kind_bias"])
        g[np.arange(n), kind] -= 1
        g /= n
        back = g @ model["kind"].T
        cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
        seen = np.flatnonzero(np.diff(cuts))
        q = np.empty((n, CLASS_SIZE), np.float32)
        for k in seen:
            own = slice(cuts[k], cuts[k + 1])
            np.matmul(h[own], model["word"][k], out=q[own])
            q[own] += model["word_bias"][k]
        q = _softmax(q)
        q[np.arange(n), inner] -= 1
        q /= n
        words = np.empty((len(seen), HIDDEN, CLASS_SIZE), np.float32)
        for i, k in enumerate(seen):
            own = slice(cuts[k], cuts[k + 1])
            back[own] += q[own] @ model["word"][k].T
            np.matmul(h[own].T, q[own], out=words[i])
        move("word", words, seen)
        move("word_bias", np.add.reduceat(q, cuts[seen], axis=0), seen)
        move("kind", h.T @ g)
        move("kind_bias", g.sum(axis=0))
        back *= 1 - h * h
        into = (back @ model["hidden"].T).reshape(-1, WIDTH)
        move("hidden", e.T @ back)
        move("hidden_bias", back.sum(axis=0))
        around = c.ravel().astype(np.int16)
        order = np.argsort(around, kind="stable")
        at, first = np.unique(around[order], return_index=True)
        move("embed", np.add.reduceat(into[order], first, axis=0), at)


class Vocabulary:
    """Symbols of word hashes, and what a spill symbol's words weigh in it."""

    def __init__(self, words: np.ndarray, spill: np.ndarray):
        order = np.argsort(words)
        self.words, self.ranks, self.spill = words[order], order.astype(np.int32), spill

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = (VOCABULARY + (hashes >> np.uint64(7)) % np.uint64(SPILL)).astype(np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            out[known] = self.ranks[at[known]]
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in text_blocks(batches, "text"):
        own, n = np.unique(split_words(batch.column("text")).hashes, return_counts=True)
        both, where = np.unique(np.concatenate((held, own)), return_inverse=True)
        held, counts = both, np.bincount(where, np.concatenate((counts, n)), len(both)).astype(np.int64)
        if len(held) > 1_000_000:
            yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(counts)], ["word", "n"])
            held, counts = held[:0], counts[:0]
    yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(counts)], ["word", "n"])


def fit_vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts of all words of all texts decide; what comes to the driver has a fixed size."""
    counts = docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = kept_table(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    # A word behind a spill symbol counts as one of the symbol's different words.
    slot = F.pmod(F.shiftrightunsigned("word", 7), F.lit(SPILL))
    sizes = {r.slot: r.n for r in counts.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    spill = np.array([max(1, sizes.get(k, 1)) for k in range(SPILL)], float)
    return Vocabulary(words, np.log(spill))


def fit_model(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", share: int = 1, rounds: int = ROUNDS) -> Model:
    """Train on every document once (with ``share``, on one in so many); a hash of id and text draws its round."""
    spark = docs.sparkSession
    drawn = F.pmod(F.xxhash64(F.col(id_col), "text", F.lit("model")), F.lit(share * rounds))
    known, model = spark.sparkContext.broadcast(vocabulary), new_model()
    for step in range(rounds):
        start, rate = spark.sparkContext.broadcast(model), 0.15 / (1 + step)

        def learn(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            own, tokens = {k: v.copy() for k, v in start.value.items()}, 0
            state = {k: np.full(v.shape, 1e-3, np.float32) for k, v in own.items()}
            for batch in text_blocks(batches, "text", 1_000_000):
                words = split_words(batch.column("text"))
                if not len(words.hashes):
                    continue
                s = known.value.symbols(words.hashes)
                order = np.random.default_rng(step).permutation(len(s))
                train(own, windows(s, words.first)[order], s[order], state, rate)
                tokens += len(s)
            if tokens:
                values = flat(own).astype(np.float64) * tokens
                yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), tokens))], ["at", "value", "tokens"])

        # Sums by parameter are taken in tasks before the shuffle; the driver gets one row for each parameter.
        got = docs.where(drawn == step).select("text").mapInArrow(learn, "at long, value double, tokens long").groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).collect()
        if not got:
            continue
        values = np.empty(len(got))
        values[[r.at for r in got]] = [r.value for r in got]
        model = shaped(values)
    return model


def score_documents(docs: DataFrame, vocabulary: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, perplexity`` for every row; sums are natural logs over all words of the text.

    A text without words (or null) has 0 tokens, log likelihood 0 and a null perplexity. Repeated rows come out
    repeatedly. Very long texts are scored in steps, whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        for batch in text_blocks(batches, "text", 2_000_000):
            words = split_words(batch.column("text"))
            counts, sums = np.diff(words.first), np.zeros(batch.num_rows)
            if len(words.hashes):
                s = known.symbols(words.hashes)
                logs = log_probabilities(own, windows(s, words.first), s).astype(np.float64)
                logs -= np.where(s >= VOCABULARY, known.spill[np.maximum(s - VOCABULARY, 0)], 0)
                sums = np.diff(np.concatenate(([0], np.cumsum(logs)))[words.first])
            mean = np.where(counts > 0, -sums / np.maximum(counts, 1), 0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts), pa.array(sums), pa.array(np.exp(np.minimum(mean, 700)), mask=counts == 0)], ["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, perplexity double")
