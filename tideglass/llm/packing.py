"""Packing of tokenised documents into sequences: best fit with certified bin counts.

Pieces are packed in partitions by best-fit decreasing. Lower bounds from dual-feasible functions certify each
partition: one whose bins are as many as its bound needs no more work. From the others the bins that are not full are
opened; their pieces move to other, fewer partitions and are packed again. Rounds end when every bin that is open
fits into partitions that are certified, or nothing more is won.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import give_back, kept_table, text_blocks
from tideglass.llm.words import text_bytes

CAPACITY = 4096
#: Pieces that one task packs together.
PER_TASK = 50_000
#: Bytes of text that a task splits into words together, unless one text is longer.
SPLIT_BYTES = 4_000_000
#: Words of several pieces with their ids that a task goes on with; above that it begins anew with those of its next texts.
HELD_WORDS = 100_000
#: Half of the encoded pieces of words that a task holds: when the younger half is full, it takes the place of the older one.
HELD_PIECES = 200_000
#: Texts in a call of the tokenizer.
CALLED = 4_096
#: Signs that form a pre-token of their own behind a word of letters.
TAIL = ".,;:!?*#$%&"
#: Words of letters that are encoded as one text.
JOINED = 256
ROUNDS = 4


class Encoder:
    """Ids of words, as little-endian bytes: each is encoded once and held while it is in use.

    Words of Latin letters are encoded in lower case, many as one text, whose words end where an id ends a word in the
    vocabulary. Signs behind such a word are a pre-token of their own and looked up apart from it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(got.ids, "<u4") for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_stems(self, stems: list[str]) -> None:
        """Encode words of letters only, ``JOINED`` at a time."""
        groups = [stems[i : i + JOINED] for i in range(0, len(stems), JOINED)] if len(self.ends) else []
        whole = [] if groups else stems
        for at in range(0, len(groups), CALLED // JOINED):
            own = groups[at : at + CALLED // JOINED]
            for group, ids in zip(own, self._encode([" ".join(g) for g in own]), strict=True):
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(cuts) == len(group) and cuts[-1] == 4 * len(ids):
                    raw = ids.tobytes()
                    self.pieces.update(zip(group, [raw[x:y] for x, y in zip([0, *cuts], cuts)]))
                else:
                    whole += group
        self._learn_pieces(whole)

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Encode each text by itself, a few thousand in a call."""
        for i in range(0, len(pieces), CALLED):
            own = pieces[i : i + CALLED]
            self.pieces.update(zip(own, (ids.tobytes() for ids in self._encode(own)), strict=True))

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those of ``pieces`` that are not held; those held from earlier texts move to the younger half."""
        new = pieces.difference(self.pieces)  # looks each one up; a view of the keys would go through the whole table
        back = [piece for piece in new if piece in self.older]
        self.pieces.update(zip(back, map(self.older.pop, back)))
        return new.difference(back)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all ``words``."""
        if len(self.words) > HELD_WORDS:
            self.words = {}
        if len(self.pieces) > HELD_PIECES:
            self.older, self.pieces = self.pieces, {}
        new = self._unknown(words.difference(self.words))
        stems = [word for word in new if word.isalpha() and word.islower() and (word.isascii() or is_plain(word))]
        parted, lows, others = [], set(), set()
        for word in new.difference(stems):
            stem = word.rstrip(TAIL)
            if stem.isalpha() and is_plain(stem):
                low, tail = stem.lower(), word[len(stem) :]
                parted.append((word, low, tail))
                lows.add(low)
                if tail:
                    others.add(tail)
            else:
                others.add(word)
        self._learn_stems(stems)
        self._learn_stems(list(self._unknown(lows)))
        self._learn_pieces(list(self._unknown(others)))
        own, several = self.pieces, self.words
        several.update([(word, own[low] + own[tail] if tail else own[low]) for word, low, tail in parted])
        return {word: ids if (ids := own.get(word)) is not None else several[word] for word in words}


def is_plain(word: str) -> bool:
    """Whether Python and the tokenizer agree on the lower case of a word of letters, and no letter is composed."""
    return word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)


_BREAK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SIGN = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_LOWER = bytes(0x20 if _BREAK[c] else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
#: First byte of the characters from U+0300 on, which a letter before them may be composed with.
_MARKS = 0xCC


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts in a row, many with a space before them, and where those of each text begin.

    Words are encoded apart: the tokenizer drops white space, joins nothing across it and lower-cases what it reads. A
    sign between a letter or digit and white space is a word: it is a pre-token of its own.
    """
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    held = raw.tobytes()
    low = np.frombuffer(bytearray(held.translate(_LOWER)), np.uint8)
    upper = np.flatnonzero(raw[1:] >= _MARKS)
    low[upper] = np.where(_ALNUM[raw[upper]], raw[upper], low[upper])
    if b"<|" in held:  # special strings are found before letters are lower-cased
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b"<|" in held[a:b]:
                low[a:b] = np.where(_BREAK[raw[a:b]], low[a:b], raw[a:b])
    cut = low == 0x20
    last = np.concatenate((cut[1:], [True]))
    starts = offsets[:-1][np.diff(offsets) > 0]
    last[starts - 1] = True  # the byte before a text ends one
    at = np.flatnonzero(_SIGN[raw] & last)
    before = raw[at - 1]
    cut[at] = _ALNUM[before] | ((raw[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))  # or a letter of U+00C0 to U+00FF
    cut[starts] = True
    cuts = np.flatnonzero(cut)
    words = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(raw))), pa.py_buffer(low)])
    return words.dictionary_encode(), np.searchsorted(cuts, offsets)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = end_id.to_bytes(4, "little")
        for batch in text_blocks(batches, "text", SPLIT_BYTES):
            cut, first = cut_words(batch.column("text"))
            words = pa.compute.ascii_trim(cut.dictionary, " ").to_numpy(zero_copy_only=False).tolist()
            known = encoder.learn(set(words))
            ids_of = list(map(known.__getitem__, words)).__getitem__
            which, first = cut.indices.to_numpy(), first.tolist()
            ids, parts, starts, lengths, sums = [], [], [], [], []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1], first[1:], strict=True):
                raw = b"".join(map(ids_of, which[a:b].tolist())) + end
                for part, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    parts.append(part)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        # The worker lives on: its tables go before the memory is given back.
        encoder = known = words = ids_of = which = cut = None
        give_back()

    return run


def document_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and the end id, cut only where they exceed ``capacity``.

    A null text is an empty one: a piece of the end id alone. Special strings are read as the library reads them.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_pieces(tokenizer_file, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and free room of the bin for each length, by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the different free rooms, sorted
    bins: dict[int, list[int]] = {}
    left: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        else:
            b, room = len(left), capacity
            left.append(capacity)
        where[i] = b
        left[b] = room = room - n
        if room:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append(b)
    return where, np.asarray(left, np.int64)[where] if len(lengths) else where


def bins_needed(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Lower bound of the bins: the largest over dual-feasible functions of the lengths.

    Functions: the length itself; with a threshold t, lengths above capacity - t count whole, those below t nothing;
    and the rounding of (k + 1) * length / capacity for small k.
    """
    x = np.asarray(lengths, np.int64)
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    sizes, counts = np.unique(x, return_counts=True)
    number, volume = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(sizes * counts)))
    small = np.unique(sizes[sizes <= capacity // 2])
    if len(small):
        low, high = np.searchsorted(sizes, small), np.searchsorted(sizes, capacity - small, side="right")
        total = (number[-1] - number[high]) * capacity + volume[high] - volume[low]
        best = max(best, int((-(-total // capacity)).max()))
    best = max(best, int(counts[sizes > capacity // 2].sum()))
    for k in range(2, 40):
        scaled = sizes * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def _pack(capacity: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = table["length"].to_numpy()
        where, left = best_fit(n, capacity)
        order = np.argsort(where, kind="stable")
        total = np.cumsum(n[order]) - n[order]
        first = np.concatenate(([True], where[order][1:] != where[order][:-1]))
        offset = np.empty(len(n), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        certified = int(where.max()) + 1 <= bins_needed(n, capacity)
        # A certified partition still hands over its one least full bin: what many leave may fill fewer together.
        loose = left > 0
        if certified:
            loose = left == left.max() if left.max() > 0 else loose
            if loose.any():
                loose &= where == where[loose].max()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.table([*(table[c] for c in names), pa.array(np.full(len(n), key[0].as_py(), np.int64)), pa.array(where), pa.array(offset), pa.array(loose)], schema=kinds)

    return run


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, bin long, offset long, open boolean"


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``: every piece in one sequence, without gaps, none above ``capacity``.

    Ties and repeated pieces are packed as separate ones; an empty table gives an empty one. Sequence ids are unique
    numbers, not consecutive ones.
    """
    done, todo, step = None, kept_table(pieces, "pieces"), 0
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    while True:
        n, tokens = todo.agg(F.count("*"), F.sum("length")).first()
        # Many pieces to a task, so that few bins stay open; never more tokens than a few thousand sequences.
        tasks = max(1, -(-n // per_task), -(-(tokens or 0) // (capacity * per_task // 8)))
        # Which pieces meet depends on the round alone, so a lost task does the same again.
        task = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(step)), F.lit(tasks)) if tasks > 1 else F.lit(0).cast("long")
        packed = kept_table(todo.withColumn("task", task).groupBy("task").applyInArrow(_pack(capacity), PACKED), f"packed{step}")
        final = tasks == 1 or step == ROUNDS
        sure = (packed if final else packed.where(~F.col("open"))).select(*columns, ((F.lit(step) * (1 << 34) + F.col("task")) * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        done = sure if done is None else done.unionByName(sure)
        if final:
            return done
        todo, step = packed.where("open").select(*columns), step + 1
