"""Removal of passages that repeat anywhere in the corpus, byte for byte.

Every window of ``WINDOW`` bytes belongs to the least hashed 16-byte gram in it, its anchor, so equal windows have equal
anchors. Windows of a text that share an anchor are one segment. Segments whose anchor occurs elsewhere are collected
by anchor, equal ones once; blocks of them are sorted by external induced sorting, and suffixes that share ``WINDOW``
bytes with a neighbour are the repeated windows. An anchor with more than ``HOT_SEGMENTS`` different segments is
not brought together: its windows are matched by 128-bit hashes instead, which spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import discard, kept_table, text_blocks
from tideglass.llm.suffix_sort import suffix_array
from tideglass.llm.words import mixed, text_bytes

WINDOW = 400
GRAM = 16
#: Bytes that are sorted together, unless one anchor has more.
SORT_BYTES = 1_000_000
#: Bytes of texts whose anchors are looked for together.
ANCHOR_BYTES = 1 << 19
HOT_SEGMENTS = 6_000
_PLACE = np.uint64((1 << 22) - 1)
#: Between segments; no byte of UTF-8 plus one has this value.
_END = 0xFE


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run with one anchor, and the anchor's hash, over texts in a row; none crosses texts."""
    n, width = len(raw), window - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))
    count = n - GRAM + 1
    grams = mixed(eight[:count] ^ (mixed(eight[8 : 8 + count] + np.uint64(0x9E3779B97F4A7C15))))
    # Ties go to the leftmost place, in every copy alike.
    value = (grams & ~_PLACE) | np.arange(count, dtype=np.uint64)
    full = np.concatenate((value, np.full(-count % width, 2**64 - 1, np.uint64))).reshape(-1, width)
    prefix = np.minimum.accumulate(full, axis=1).ravel()
    suffix = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - window + 1
    least = (np.minimum(suffix[:windows], prefix[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int32)
    last = np.repeat(offsets[1:], np.diff(offsets))[:windows] - window  # last window of the text at each place
    valid = np.flatnonzero(np.arange(windows) <= last)
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = least[valid]
    change = np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)))
    starts = np.flatnonzero(change)
    ends = np.concatenate((starts[1:], [len(valid)])) - 1
    return valid[starts], valid[ends], grams[own[starts]]


def _anchors(window: int):
    step = ANCHOR_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", step):
            raw, offsets = text_bytes(batch.column("text"))
            parts = []
            if len(raw) <= 2 * step:
                parts.append(anchor_runs(raw, offsets, window))
            else:  # one very long text: windows by stretches, whose texts overlap
                for a in range(0, len(raw), step):
                    piece = raw[a : a + step + window - 1]
                    p0, p1, h = anchor_runs(piece, np.array([0, len(piece)]), window)
                    parts.append((p0 + a, p1 + a, h))
            p0, p1, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            docs = np.searchsorted(offsets, p0, side="right") - 1
            keys = batch.column("tkey").take(pa.array(docs))
            yield pa.record_batch([keys, pa.array(p0 - offsets[docs]), pa.array(p1 - offsets[docs]), pa.array(h.view(np.int64))], ["tkey", "p0", "p1", "anchor"])

    return run


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1_000_000):
            keys, places, ends, anchors, hots, ids, segments = [], [], [], [], [], [], []
            for key, text, runs in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                for r in runs:
                    own = raw[r["p0"] : r["p1"] + window]
                    keys.append(key)
                    places.append(r["p0"])
                    ends.append(r["p1"])
                    anchors.append(r["anchor"])
                    hots.append(r["hot"])
                    ids.append(hashlib.md5(own).digest())
                    segments.append(own)
            yield pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(ends, pa.int64()), pa.array(anchors, pa.int64()), pa.array(hots, pa.bool_()), pa.array(ids, pa.binary()), pa.array(segments, pa.binary())],
                ["tkey", "p0", "p1", "anchor", "hot", "sid", "segment"],
            )

    return run


def repeated_windows(segments: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment the starts of its windows that also start elsewhere in the segments, in order."""
    sizes = np.array([len(s) for s in segments])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.frombuffer(b"\xfd".join(segments) + b"\xfd", np.uint8) + np.uint8(1)  # 0xFD + 1 is _END
    places, common = suffix_array(text)
    long = common >= window
    hit = places[long | np.append(long[1:], False)]
    owner = np.searchsorted(begins, hit, side="right") - 1
    inside = hit + window <= begins[owner] + sizes[owner]
    hit, owner = hit[inside], owner[inside]
    order = np.lexsort((hit, owner))
    hit, owner = hit[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [hit[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begins[:-1], strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist(), strict=True))


def _sort_blocks(window: int):
    """Rows ordered by anchor; blocks end between anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[bytes] = []
        held: list[bytes] = []
        size, last = 0, None

        def out():
            ids, froms, tos = [], [], []
            for sid, starts in zip(held_ids, repeated_windows(held, window), strict=True):
                for a, b in _runs(starts):
                    ids.append(sid)
                    froms.append(a)
                    tos.append(b)
            return pa.record_batch([pa.array(ids, pa.binary()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())], ["sid", "a", "b"])

        for batch in batches:
            for anchor, sid, segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sid", "segment")), strict=True):
                if size >= SORT_BYTES and anchor != last:
                    yield out()
                    held_ids, held, size = [], [], 0
                held_ids.append(sid)
                held.append(segment)
                size += len(segment) + 1
                last = anchor
        if held:
            yield out()

    return run


def _hash_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, places, marks = [], [], []
                for sid, segment in zip(part.column("sid").to_pylist(), part.column("segment").to_pylist(), strict=True):
                    for a in range(len(segment) - window + 1):
                        ids.append(sid)
                        places.append(a)
                        marks.append(xxhash.xxh3_128_digest(segment[a : a + window]))
                yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(places, pa.int64()), pa.array(marks, pa.binary())], ["sid", "a", "mark"])

    return run


def _merge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column("found"):
                x = np.array([(r["a"].as_py(), r["b"].as_py()) for r in found.values], np.int64).reshape(-1, 2)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1] + window)
                new = np.concatenate(([True], x[1:, 0] > reach[:-1]))
                ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(x[new, 0], ends, strict=True)])
            yield pa.record_batch([batch.column("tkey"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["tkey", "spans"])

    return run


def with_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``spans``: the byte ranges of each text covered by repeated windows, merged and in order.

    A window repeats if it starts anywhere else, in the same text or another row; equal rows count as different places.
    Null and short texts have no spans (an empty list). All columns stay; a column ``spans`` of its own is replaced.
    """
    key = F.unhex(F.md5(F.col(text_col)))
    base = docs.select(F.col(text_col).alias("text"), key.alias("tkey")).where(F.octet_length("text") >= window)
    # A row number would change when a task is repeated; a hash of the row's place would too. The least hash of a
    # text's own columns picks one row, and rows that are equal in all columns are taken together.
    mark = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c != text_col]) if len(docs.columns) > 1 else F.lit(0).cast("long")
    marked = docs.select(F.col(text_col).alias("text"), key.alias("tkey"), mark.alias("mark")).where(F.octet_length("text") >= window)
    bag: list[str] = []
    early: list[str] = []
    texts = kept_table(marked.groupBy("tkey").agg(F.min("mark").alias("mark"), F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("size")), "texts", bag)
    anchors = kept_table(base.mapInArrow(_anchors(window), "tkey binary, p0 long, p1 long, anchor long").dropDuplicates(["tkey", "p0"]), "anchors", early)
    # As a table, so that the join below can split the rows of one frequent anchor.
    often = kept_table(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often", early)
    runs = anchors.join(often, "anchor").groupBy("tkey").agg(F.collect_list(F.struct("p0", "p1", "anchor", (F.col("n") > HOT_SEGMENTS).alias("hot"))).alias("runs"))
    wanted = runs.join(texts.select("tkey", "mark"), "tkey")
    segments = kept_table(marked.join(wanted, ["tkey", "mark"]).select("tkey", "text", "runs").mapInArrow(_segments(window), "tkey binary, p0 long, p1 long, anchor long, hot boolean, sid binary, segment binary"), "segments", bag)
    discard(docs.sparkSession, early)
    counts = segments.groupBy("sid").agg(F.count("*").alias("n"))
    # Other segments of a window that lies in two equal ones need one of these only.
    different = segments.dropDuplicates(["sid"]).select("anchor", "hot", "sid", "segment")
    cold = different.where(~F.col("hot")).select("anchor", "sid", "segment").repartition("anchor").sortWithinPartitions("anchor", "sid").mapInArrow(_sort_blocks(window), "sid binary, a long, b long")
    hashed = different.where("hot").select("sid", "segment").mapInArrow(_hash_windows(window), "sid binary, a long, mark binary")
    twice = hashed.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    hot = hashed.join(twice, "mark", "left_semi").select("sid", "a", F.col("a").alias("b"))
    parts = kept_table(cold.unionByName(hot), "parts", bag)
    by_sid = parts.groupBy("sid").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    # What is found of each segment, as a table: the one join with all places can then split those of a frequent segment.
    facts = counts.join(by_sid, "sid", "left").select("sid", "n", F.when(F.col("n") == 1, F.col("parts")).alias("parts")).where("n > 1 or parts is not null")
    facts = kept_table(facts, "facts", bag)
    places = segments.select("tkey", "p0", "p1", "sid").join(facts, "sid")
    whole = F.array(F.struct(F.col("p0").alias("a"), F.col("p1").alias("b")))
    moved = F.transform("parts", lambda x: F.struct((x["a"] + F.col("p0")).alias("a"), (x["b"] + F.col("p0")).alias("b")))
    found = places.select("tkey", F.when(F.col("n") > 1, whole).otherwise(moved).alias("found"))
    spans = found.groupBy("tkey").agg(F.flatten(F.collect_list("found")).alias("found")).mapInArrow(_merge(window), "tkey binary, spans array<struct<start:bigint,end:bigint>>")
    full = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    all_spans = texts.join(spans, "tkey", "left").select(F.col("tkey").alias("own_key"), F.when(F.col("copies") > 1, full).otherwise(F.col("spans")).alias("own_spans")).where("own_spans is not null")
    all_spans = kept_table(all_spans, "spans")
    discard(docs.sparkSession, bag)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # In a struct, columns of any name stay apart from those of the join.
    packed = docs.drop("spans").select(F.struct("*").alias("row"), key.alias("own_key"))
    return packed.join(all_spans, "own_key", "left").select("row.*", F.coalesce("own_spans", none).alias("spans"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, removed = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, at, mark, gone = (text or "").encode(), 0, hashlib.sha256(), 0
            for s in spans:
                mark.update(raw[at : s["start"]])
                at = s["end"]
                gone += s["end"] - s["start"]
            mark.update(raw[at:])
            marks.append(mark.hexdigest())
            removed.append((len(raw), gone, len(spans)))
        sizes, gone, runs = zip(*removed, strict=True) if removed else ([], [], [])
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(marks, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(spanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the rows that :func:`with_repeats` gives."""
    own = spanned.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "spans")
    return own.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                raw, kept, at = text.encode(), [], 0
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                # Bytes of a character that a span cuts through go with it.
                text = b"".join([*(k.decode(errors="ignore").encode() for k in kept), raw[at:].decode(errors="ignore").encode()]).decode()
            out.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(out, batch.schema.field(at).type)).drop_columns(["spans"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; every row and every other column stays."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return with_repeats(docs, "text", window).select(*docs.columns, "spans").mapInArrow(_cut, kinds)
