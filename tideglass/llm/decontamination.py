"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A bit table of fixed size tells tasks which word n-grams of a text may belong to a test item; around each such place a
passage is cut out. How many passages have each n-gram is counted over all documents, which tells the n-grams of an item
that are rare for it: not much more frequent than the median of its own. Passages that share a rare seed with an item are
aligned with it word by word. Passages that share only common ones are aligned too, unless they have so few of its words
that no alignment can reach the threshold: a variant in very many documents makes its own seeds common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import kept_table, text_blocks
from tideglass.llm.words import Words, shingles, split_words

#: Words of a seed. An item with fewer words has its whole sequence as its one seed, which is looked up at its own size.
SEED_WORDS = 3
#: Bits of the table that all tasks hold (1 MiB), whatever the size of the benchmark.
TABLE_BITS = 23
#: A rare seed may be so many times as frequent as the median n-gram of its item, or occur FLOOR times anyway.
RARE_FACTOR, FLOOR = 4, 16
MATCH, OTHER, GAP = 2, -1, -1
#: Share of the best score of an item from which a passage counts as a copy of it.
LEAK = 0.5
_BITS = np.uint64(64 - TABLE_BITS)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "text"):
        words = split_words(batch.column("text"))
        values, first = shingles(words, SEED_WORDS)
        lists = [pa.array([x[f[i] : f[i + 1]] for i in range(batch.num_rows)], pa.list_(pa.int64())) for x, f in ((values.view(np.int64), first), (words.hashes.view(np.int64), words.first))]
        yield pa.record_batch([batch.column("item_id"), *lists], ["item_id", "seeds", "words"])


def best_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences and the passage's part ``[start, end)`` that it aligns."""
    n = len(passage)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, where = 0, (0, 0)
    steps = np.arange(n + 1) * -GAP
    for word in item:
        hit = np.where(passage == word, MATCH, OTHER)
        up, diagonal = score + GAP, np.concatenate(([0], score[:-1] + hit))
        new = np.maximum(np.maximum(up, diagonal), 0)
        start = np.where(diagonal >= up, np.concatenate(([0], begin[:-1])), begin)
        start = np.where(new == 0, np.arange(n + 1), start)
        # Gaps along the passage: the best of all cells to the left, less a gap for each step.
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - steps
        begin = start[source]
        at = int(score.argmax())
        if score[at] > best:
            best, where = int(score[at]), (int(begin[at]), at)
    return best, *where


def _found(words: Words, bits: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word in the text and hash of every n-gram that the bit table may hold, of ``SEED_WORDS`` or ``short`` words."""
    parts = []
    for size in (SEED_WORDS, *short):
        values, first = shingles(words, size)
        if size < SEED_WORDS:  # as the seed of an item that has no more words
            values, first = whole_sequences(words, size)
        slot = values >> _BITS
        hits = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        docs = np.searchsorted(first, hits, side="right") - 1
        parts.append((docs, hits - first[docs], values[hits]))
    docs, at, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, docs))
    return docs[order], at[order], values[order]


def whole_sequences(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``size`` words as the hash that a text of just these words has, and where those of each text begin."""
    own = np.maximum(np.diff(words.first) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(own)))
    start = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], own)
    picked = (start[:, None] + np.arange(size)).ravel()
    runs = Words(words.hashes[picked], words.starts[picked], words.ends[picked], np.arange(0, len(picked) + 1, size))
    return shingles(runs, SEED_WORDS)[0], first


def _passages(bits: np.ndarray, reach: int, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            words = split_words(batch.column("text"))
            docs, hits, values = _found(words, bits, short)
            ids = batch.column("doc_id")
            out: list[tuple] = []
            # Hits of a text that lie close together make one passage.
            cuts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (hits[1:] - hits[:-1] > 2 * reach)))) if len(hits) else []
            for a, b in zip(cuts, [*cuts[1:], len(hits)][: len(cuts)], strict=True):
                d = int(docs[a])
                w0, w1 = words.first[d], words.first[d + 1]
                lo = max(w0, w0 + hits[a] - reach)
                hi = min(w1, w0 + hits[b - 1] + SEED_WORDS + reach)
                out.append((ids[d].as_py(), int(words.starts[lo]), np.unique(values[a:b].view(np.int64)), words.hashes[lo:hi].view(np.int64), words.starts[lo:hi], words.ends[lo:hi]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "at", "seeds", "words", "starts", "ends"])

    return run


def _align(leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores, froms, tos = [], [], [], []
            items, words, starts, ends = (batch.column(c) for c in ("item", "words", "starts", "ends"))
            rare = batch.column("rare").to_pylist()
            for i in range(batch.num_rows):
                item, passage = items[i].values.to_numpy(), words[i].values.to_numpy()
                # A score is MATCH for each word of the item that the passage has, at most.
                if not rare[i] and np.isin(item, passage).sum() < leak * len(item):
                    continue
                # The table of a batch of equal pairs is small: item words times passage words.
                score, a, b = best_alignment(item, passage)
                if score >= leak * MATCH * len(item):
                    keep.append(i)
                    scores.append(score / (MATCH * len(item)))
                    froms.append(starts[i].values[a].as_py())
                    tos.append(ends[i].values[b - 1].as_py())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([own.column("doc_id"), own.column("key"), pa.array(scores, pa.float64()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())], ["doc_id", "key", "score", "start", "end"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", leak: float = LEAK) -> DataFrame:
    """``doc_id, item_id, score, start, end``: for each document and item the best passage aligned with the item.

    ``score`` is the alignment's share of the item's best score (1: a whole copy), ``leak`` or more; start and end are
    byte places in the text. Null or wordless texts and items match nothing; items with the same words are each
    reported; repeated documents give one row per item. Rows with a null id are searched and reported like the others.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_item_seeds, "item_id long, seeds array<long>, words array<long>")
    every = kept_table(read.where("size(words) > 0").withColumn("key", F.xxhash64("words")), "items")
    unique = kept_table(every.groupBy("key").agg(F.first("seeds").alias("seeds"), F.first("words").alias("words")), "unique")
    # One bit for each seed; at most 2^(TABLE_BITS - 6) rows come to the driver.
    slot = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    marked = every.select(F.explode("seeds").alias("seed")).select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), "<i8")
    for row in marked.toLocalIterator():
        table[row.word] = row.bits
    reach = every.agg(F.max(F.size("words"))).first()[0] or 0
    shared = table.view(np.uint8)
    short = [r.n for r in every.select(F.size("words").alias("n")).where(F.col("n") < SEED_WORDS).distinct().collect()]  # below SEED_WORDS
    found = docs.mapInArrow(_passages(shared, reach, sorted(short)), "doc_id long, at long, seeds array<long>, words array<long>, starts array<long>, ends array<long>")
    passages = kept_table(found.withColumn("print", F.xxhash64("words")), "passages")
    hits = passages.select("doc_id", "at", "print", F.explode("seeds").alias("seed"))
    df = hits.groupBy("seed").agg(F.count("*").alias("df"))
    own = unique.select("key", F.explode(F.array_distinct("seeds")).alias("seed")).join(df, "seed")
    usual = own.groupBy("key").agg(F.percentile_approx("df", 0.5, 1000).alias("usual"))
    rare = (F.col("df") <= RARE_FACTOR * F.col("usual")) | (F.col("df") <= FLOOR)
    seeds = kept_table(own.join(usual, "key").select("seed", "key", rare.alias("rare")), "seeds")
    pairs = hits.join(seeds, "seed").groupBy(F.col("doc_id").alias("of"), F.col("at").alias("a"), F.col("print").alias("p"), "key").agg(F.max("rare").alias("rare"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("a")) & (F.col("print") == F.col("p"))
    joined = passages.join(pairs, same).select("doc_id", "key", "rare", "words", "starts", "ends").join(unique.select("key", F.col("words").alias("item")), "key")
    aligned = joined.mapInArrow(_align(leak), "doc_id long, key long, score double, start long, end long")
    best = aligned.groupBy("doc_id", "key").agg(F.max(F.struct("score", F.negative("start").alias("s"), "end")).alias("b")).select("doc_id", "key", "b.score", F.negative("b.s").alias("start"), "b.end")
    return best.join(every.select("key", "item_id"), "key").select("doc_id", "item_id", "score", "start", "end")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", leak: float = LEAK) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item; all columns stay, whatever their names.

    Whether a row leaks depends on its text alone, so rows go by a 64-bit hash of it, never by their ids.
    """
    key = F.xxhash64(text_col)
    hit = leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text", leak=leak).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(hit, "key", "left_anti").select("row.*")
