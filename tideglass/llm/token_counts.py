"""Token counts without token ids.

A text is cut at every single space that stands between two non-space characters. The tokenizer's own pattern never
joins what lies on the two sides of such a space, so these pre-tokens are encoded alike alone and in their text, and
the pieces of each distinct one are counted once by the library. Texts then only need frequencies of pre-tokens.

The most frequent pre-tokens (``HOT_ROWS`` at most, of ``HOT_CHARS`` characters at most, so a bounded table) go to all
tasks; all others are joined by a shuffle. Special strings inside a text are single tokens, as the library has it.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import kept_table, text_blocks

#: Bound of the table that every task holds: rows, and characters of a pre-token.
HOT_ROWS = 400_000
HOT_CHARS = 48
#: A task hands its counts over when it holds so many distinct pre-tokens.
HELD_ROWS = 400_000
UNSAFE = re.compile(r"\s | \s|^ | $")
CUT = re.compile(r"(?<=\S) (?=\S)")


def pre_tokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: the first one behind a space, the others without the space they begin with."""
    parts = CUT.split(text) if UNSAFE.search(text) else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


def spelled(key: str) -> str:
    """The characters that a key stands for."""
    return key[1:] if key.startswith(" ") else " " + key


def _count_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["key", "n"])

    for batch in batches:
        for text in batch.column(0):
            if text := text.as_py():
                held.update(pre_tokens(text))
                if len(held) > HELD_ROWS:
                    yield out()
                    held = Counter()
    yield out()


def _piece_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in text_blocks(batches, "key", 1_000_000):
            found = tokenizer.encode_batch_fast([spelled(k) for k in batch.column("key").to_pylist()], add_special_tokens=False)
            yield pa.record_batch([batch.column("key"), batch.column("n"), pa.array([len(x) for x in found], pa.int64())], ["key", "n", "pieces"])

    return run


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``; the file must be there on every executor.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows come out as often as they came in, also with a null
    id. Other columns are ignored whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.select("text").mapInArrow(_count_corpus, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pieces = kept_table(found.mapInArrow(_piece_counter(tokenizer_file), "key string, n long, pieces long"), "pieces")
    hot = pieces.where((F.col("n") > 1) & (F.length("key") <= HOT_CHARS)).orderBy(F.desc("n"), "key").limit(HOT_ROWS)
    shared = spark.sparkContext.broadcast({r.key: r.pieces for r in hot.select("key", "pieces").toLocalIterator()})

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = shared.value
        for batch in text_blocks(batches, "text"):
            ids, prints, sizes, keys, counts = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                raw = text.encode()
                mark, sure, rest = xxhash.xxh3_128_digest(raw), 0, {}
                if text:
                    for key in pre_tokens(text):
                        n = known.get(key)
                        if n is None:
                            rest[key] = rest.get(key, 0) + 1
                        else:
                            sure += n
                # The first row stands for the text itself, those with a key for what is not known here.
                ids.extend([doc] * (1 + len(rest)))
                prints.extend([mark] * (1 + len(rest)))
                sizes.append(len(raw))
                sizes.extend([None] * len(rest))
                keys.append(None)
                keys.extend(rest)
                counts.append(sure)
                counts.extend(rest.values())
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())],
                ["doc_id", "print", "n_bytes", "key", "n"],
            )

    parts = docs.mapInArrow(by_document, "doc_id long, print binary, n_bytes long, key string, n long")
    known = pieces.select("key", "pieces")
    joined = parts.join(known, "key", "left").withColumn("tokens", F.col("n") * F.coalesce("pieces", F.lit(1)))
    # Rows that are the same twice add up to twice the sum; they are told apart by the number of first rows.
    sums = joined.groupBy("doc_id", "print").agg(F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"), F.count("n_bytes").alias("copies"))
    return sums.select("doc_id", "n_bytes", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
