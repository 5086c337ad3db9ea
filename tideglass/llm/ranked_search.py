"""Ranked lexical search: the documents that score highest for each item, term at a time with few accumulators.

Terms of the items are looked up in every whole text once; a document becomes the list of item terms it holds. Corpus
statistics are sums over all documents. Each task then inverts blocks of documents and takes an item's terms one by one,
rarest first: a term opens accumulators for its documents until what the remaining terms can add at most falls below the
``k``-th score known so far; from then on only documents that have an accumulator are updated, so their scores are whole.
A task keeps the ``k`` best of each item over all its blocks; the bests of all tasks meet in two steps. Postings are
never shuffled, so a term that a third of all documents hold costs no task more than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import discard, kept_table, text_blocks
from tideglass.llm.runs import split_runs

#: Pairs (item, term) that are searched together and sent to the tasks; more items are searched in several blocks.
BLOCK_PAIRS = 1 << 18
#: Groups in which the bests of the tasks meet before the last step.
MERGE_GROUPS = 1_024


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "text"):
        runs = split_runs(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(runs.first))
        yield pa.record_batch([batch.column("item_id").take(pa.array(owner)), pa.array(runs.hashes.view(np.int64))], ["item_id", "term"])


def _count_terms(shared):
    """Rows ``doc_id, n`` and the places in the vocabulary and frequencies of the terms that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in text_blocks(batches, "text"):
            runs = split_runs(batch.column("text"))
            at = np.minimum(np.searchsorted(vocabulary, runs.hashes), len(vocabulary) - 1)
            known = vocabulary[at] == runs.hashes
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(runs.first))
            pairs, tf = np.unique(owner[known] * len(vocabulary) + at[known], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(vocabulary)) * 4
            offsets = pa.py_buffer(cuts.astype("<i4").tobytes())
            column = lambda x: pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(x.astype("<i4").tobytes())])  # noqa: B023, E731
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(runs.first)), column(pairs % len(vocabulary)), column(tf)], ["doc_id", "n", "terms", "tf"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(_numbers(batch.column("terms")), minlength=len(total))
        found[: len(total)] += total
        total = found
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "df"])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


@dataclass
class Corpus:
    """Documents with a term, all terms with repeats, and by place in the vocabulary the documents that hold a term."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(d) + 1))) for d in self.df], np.int64)


class Inverted:
    """Postings of a block of documents by term, with what a term adds to a document for a weight of 1."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        terms, tf = _numbers(batch.column("terms")), _numbers(batch.column("tf"))
        sizes = pa.compute.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4
        n = batch.column("n").to_numpy(zero_copy_only=False)
        m = 25 + (75 * n * corpus.n_docs) // corpus.n_terms
        docs = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs = docs[order]
        tf = tf[order]
        self.gain = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[self.docs])
        self.first = np.searchsorted(terms[order], np.arange(len(corpus.df) + 1))
        self.peak = np.zeros(len(corpus.df), np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.gain, self.first[held])
        self.size = len(sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the ``k`` best of the block with their whole scores, all above 0.

        ``terms`` come rarest first. ``least`` is a score that ``k`` documents elsewhere reach: a document below it is
        of no use. A document that could tie with the ``k``-th is never left out.
        """
        rest = np.cumsum((weights * self.peak[terms])[::-1])[::-1]
        score = np.zeros(self.size, np.int64)
        opened = np.zeros(self.size, bool)
        opening, highest = True, 0
        for j, (t, w) in enumerate(zip(terms, weights, strict=True)):
            docs, gain = self.docs[self.first[t] : self.first[t + 1]], self.gain[self.first[t] : self.first[t + 1]]
            if opening and (rest[j] < least or (rest[j] < highest and rest[j] < _kth(score[opened], k))):
                opening = False
            if opening:
                opened[docs] = True
            else:
                held = opened[docs]
                docs, gain = docs[held], gain[held]
            score[docs] += w * gain
            highest = max(highest, int(score[docs].max(initial=0)))
        at = np.flatnonzero(score > 0)
        at = at[score[at] >= max(least, _kth(score[at], k))]
        return at, score[at]


def _kth(scores: np.ndarray, k: int) -> int:
    """The ``k``-th highest score, 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search(shared, corpus: Corpus, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        weight = corpus.weights()
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        plans = []
        for _, terms, times in queries:
            order = np.lexsort((terms, corpus.df[terms]))
            plans.append((terms[order], weight[terms[order]] * times[order]))
        for batch in batches:
            block = Inverted(batch, corpus)
            column = batch.column("doc_id")
            ids, nulls = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            for q, (terms, weights) in enumerate(plans):
                scores, docs, gone = best[q]
                at, found = block.search(terms, weights, k, int(scores[-1]) if len(scores) == k else 0)
                if len(at):
                    scores, docs, gone = (np.concatenate(x) for x in ((scores, found), (docs, ids[at]), (gone, nulls[at])))
                    top = np.lexsort((docs, gone, -scores))[:k]
                    best[q] = scores[top], docs[top], gone[top]
        task = TaskContext.get().partitionId() % MERGE_GROUPS
        for (item, _, _), (scores, docs, gone) in zip(queries, best, strict=True):
            if len(scores):
                yield pa.record_batch([pa.array([item] * len(scores), pa.int64()), pa.array([task] * len(scores), pa.int32()), pa.array(docs, mask=gone), pa.array(scores)], ["item_id", "task", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents with the highest scores above 0.

    Scores are integers as in the module's contract (length-normalised term frequencies, weights from document
    frequencies over all documents). Null and empty texts have no terms: such a document is in no result and in no
    statistic, such an item has no result. Equal scores rank by id, null ids last; repeated rows of a document are
    documents of their own. Rows with one item id, null included, are one item whose terms add up. Other columns are not
    read. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    bag: list[str] = []
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    terms = kept_table(asked.mapInArrow(_item_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times")), "item-terms", bag)
    blocks = -(-terms.count() // block_pairs)
    out = empty
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()  # about block_pairs rows
        if not own.num_rows:
            continue
        vocabulary, place = np.unique(own["term"].to_numpy().view(np.uint64), return_inverse=True)
        named = own["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        item, times = named.indices.to_numpy(), own["times"].to_numpy()
        queries = [(name, place[item == i], times[item == i]) for i, name in enumerate(named.dictionary.to_pylist())]
        counted_bag: list[str] = []
        counted = kept_table(texts.mapInArrow(_count_terms(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms binary, tf binary"), "term-counts", counted_bag)
        whole = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not whole.docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the vocabulary
            df[r.term] = r.df
        found = counted.mapInArrow(_search(spark.sparkContext.broadcast(queries), Corpus(whole.docs, whole.terms, df), k), "item_id long, task int, doc_id long, score long")
        merged = _best(_best(found, k, "item_id", "task").drop("rank"), k, "item_id")
        out = out.unionByName(kept_table(merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        discard(spark, counted_bag)
    discard(spark, bag)
    return out
