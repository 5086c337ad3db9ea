"""Near-duplicate documents by MinHash with tensored banding.

Instead of a fresh set of MinHashes for every table, ``HALVES`` small collections of ``ROWS`` MinHashes are computed
and each pair of collections makes a table key: 32 MinHashes give 120 tables of four, about the root of what separate
tables would need. Two sets with similarity 0.75 agree in 9 of the 16 collections on average and in fewer than two with
a chance of 4e-5, far less above.

Equal sets are one class from the start. Half keys that one class alone has make no table keys. In a table, members of
a bucket are compared with one representative, drawn by a hash of the row alone, so that the buckets of a group mostly
have the same one; that joins what is alike in few comparisons. Buckets that then hold one component are done. Rows of
large buckets with several components make clusters, and the full sets of each cluster are compared across components,
block by block. Of the other buckets with several components, those of few rows, all pairs across components are
compared that no cluster has seen. So every pair that meets in a bucket is in one component or was compared, and every
link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import bound_batches, discard, give_back, kept_table, maybe_in, text_blocks
from tideglass.llm.components import components
from tideglass.llm.words import mixed, shingles, split_words

HALVES = 16
ROWS = 2
#: In buckets of so many rows at most, all pairs across components are compared.
SMALL_BUCKET = 24
#: Rows of a block of the exact rest, on average, and columns of its tables.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 16_384
_SEEDS = mixed(np.arange(1, HALVES * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTORS = mixed(_SEEDS) | np.uint64(1)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHashes of each set in a row, 32 bits each; sets must not be empty."""
    out = np.empty((len(first) - 1, HALVES * ROWS), "<u4")
    if len(out):
        for k in range(HALVES * ROWS):
            out[:, k] = np.minimum.reduceat((values ^ _SEEDS[k]) * _FACTORS[k], first[:-1]) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _distinct(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _set_key(values: np.ndarray) -> bytes:
    """128 bits of a distinct set, whatever its order."""
    one, two = mixed(values + np.uint64(0x632BE59BD9B4E019)), mixed(values ^ np.uint64(0x9E6C63D0876A9A47))
    return one.sum(dtype=np.uint64).tobytes() + mixed(two).sum(dtype=np.uint64).tobytes()


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            values, first = shingles(split_words(batch.column("text")), size)
            sets = _distinct(values, first)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            marks: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if len(full):
                own = signatures(values, np.concatenate((first[full], first[-1:])))
                for d, row in zip(full, own, strict=True):
                    marks[d], keys[d] = row.tobytes(), _set_key(sets[d])
            kept = batch.drop_columns(["text"])
            yield pa.record_batch([*kept.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], [*kept.schema.names, "n_shingles", "set_key", "marks"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            sets = _distinct(*shingles(split_words(batch.column("text")), size))
            # Ids need not be unique: only the text with the wanted set counts.
            own = [s.astype("<u8").tobytes() if len(s) and _set_key(s) == k else None for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("set_key"), pa.array(own, pa.binary())], ["set_key", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))  # in place: a batch may be large
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                hits.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))
            yield pa.record_batch(keep.columns, ["a", "b"])
        give_back()

    return run


def _pair(one: str, two: str):
    return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")


def _representative_pairs(buckets: DataFrame, bag: list[str]) -> DataFrame:
    """Pairs ``a, b`` of each row with the representatives of its buckets."""
    drawn = F.min(F.struct(F.xxhash64("id", F.lit(0)).alias("h"), "id"))["id"].alias("head")
    heads = kept_table(buckets.groupBy("bucket").agg(drawn), "heads", bag)
    return buckets.join(heads, "bucket").where("id <> head").select(*_pair("id", "head")).distinct()


def _clusters(mixed: DataFrame, bag: list[str]) -> DataFrame:
    """``id, comp, cluster`` of rows in large buckets with several components; such buckets join their rows."""
    large = mixed.where(F.col("n") > SMALL_BUCKET)
    least = large.groupBy("bucket").agg(F.min("id").alias("a"))
    left = kept_table(large.join(least, "bucket").select("id", "comp", "a").distinct(), "left", bag)
    cluster = components(left.select("a", F.col("id").alias("b")))
    return kept_table(left.select("id", "comp").distinct().join(cluster.toDF("id", "cluster"), "id"), "clusters", bag)


def _small_pairs(mixed: DataFrame, clusters: DataFrame) -> DataFrame:
    """All pairs across components in the other buckets with several, but those that one cluster holds."""
    few = mixed.where(F.col("n") <= SMALL_BUCKET).select("bucket", "id", "comp").join(clusters.select("id", "cluster"), "id", "left")
    few = few.withColumn("place", F.coalesce("cluster", "id"))
    open_ = few.groupBy("bucket").agg(F.min("place").alias("p0"), F.max("place").alias("p1")).where("p0 <> p1").select("bucket")
    rows = F.sort_array(F.collect_list(F.struct("id", "comp", "place")))
    group = few.join(open_, "bucket", "left_semi").groupBy("bucket").agg(rows.alias("rows"))  # SMALL_BUCKET rows at most
    one = group.select("rows", F.posexplode("rows").alias("at", "x"))
    two = one.select("x", F.explode(F.expr("filter(rows, (r, i) -> i > at and r.comp <> x.comp and r.place <> x.place)")).alias("y"))
    return two.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _linked_blocks(percent: int):
    """Links across components between the rows of two blocks (or in one), as few as join what is linked."""

    def run(group: pa.Table) -> pa.Table:
        ids, comps, side = (group.column(c).to_pylist() for c in ("id", "comp", "side"))
        sets = [np.frombuffer(x, "<u8") for x in group.column("members").to_pylist()]
        code = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        left = [i for i, s in enumerate(side) if s == 0]
        right = [i for i, s in enumerate(side) if s == 1] or left
        a_out, b_out = [], []
        if left and len(code) > 1:
            parts = [(np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])) for own in (left, right)]
            both = np.intersect1d(parts[0][0], parts[1][0])
            shared = np.zeros((len(left), len(right)))
            for k in range(0, len(both), BLOCK_COLUMNS):
                some = both[k : k + BLOCK_COLUMNS]
                tables = []
                for (values, row), own in zip(parts, (left, right), strict=True):
                    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
                    hit = some[at] == values
                    table = np.zeros((len(own), len(some)), np.float32)
                    table[row[hit], at[hit]] = 1
                    tables.append(table)
                shared += tables[0] @ tables[1].T
            n, m = (np.array([len(sets[i]) for i in own]) for own in (left, right))
            kinds = np.array([code[c] for c in comps])
            near = (100 * shared >= percent * (n[:, None] + m[None, :] - shared)) & (kinds[left][:, None] != kinds[right][None, :])
            up = list(range(len(code)))
            for x, y in np.argwhere(near):
                i, j = left[x], right[y]
                p, q = kinds[i], kinds[j]
                while up[p] != p:
                    p = up[p] = up[up[p]]
                while up[q] != q:
                    q = up[q] = up[up[q]]
                if p != q:
                    up[p] = q
                    a_out.append(ids[i])
                    b_out.append(ids[j])
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return run


def _rest_links(rows: DataFrame, percent: int, bag: list[str]) -> DataFrame:
    """Links ``a, b`` across components among ``rows`` (``id, comp, cluster, n, members``), all pairs of a cluster."""
    # Sets that can be similar enough are in the same band of sizes or in neighbouring ones.
    width = max(math.log(100 / percent) * 1.001, 0.01) if percent > 0 else 1e9
    banded = rows.withColumn("band", F.floor(F.log("n") / F.lit(width)))
    counts = banded.groupBy("cluster", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("parts"))
    dealt = kept_table(banded.join(counts, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("cluster", "band", "part", "id", "comp", "members"), "dealt", bag)
    blocks = kept_table(dealt.groupBy("cluster", "band", "part").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")), "blocks", bag)
    x, y = blocks.toDF("cluster", "xb", "xp", "x0", "x1"), blocks.toDF("cluster", "yb", "yp", "y0", "y1")
    ordered = ((F.col("yb") == F.col("xb")) & (F.col("yp") >= F.col("xp"))) | (F.col("yb") == F.col("xb") + 1)
    several = F.least("x0", "y0") != F.greatest("x1", "y1")
    met = kept_table(x.join(y, "cluster").where(ordered & several).select("cluster", "xb", "xp", "yb", "yp"), "met", bag)
    first = met.withColumn("band", F.col("xb")).withColumn("part", F.col("xp")).withColumn("side", F.lit(0))
    second = met.where("xb <> yb or xp <> yp").withColumn("band", F.col("yb")).withColumn("part", F.col("yp")).withColumn("side", F.lit(1))
    sides = dealt.join(first.unionByName(second), ["cluster", "band", "part"])
    return sides.groupBy("cluster", "xb", "xp", "yb", "yp").applyInArrow(_linked_blocks(percent), "a binary, b binary")


def _merged(roots: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``roots`` after the links ``new``."""
    merged = components(new.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    old = roots.join(merged.toDF("root", "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    return kept_table(old.unionByName(merged.join(roots.select("id"), "id", "left_anti").select("id", "root")), name)


def _components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs (doc_id, text, ...)`` without text but with ``n_shingles`` and ``set_key``, and ``set_key, root,
    component_id`` of every set."""
    bag: list[str] = []
    bound_batches(docs.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    prints = kept_table(docs.mapInArrow(_prints(size), f"{kinds}, n_shingles long, set_key binary, marks binary"), "prints")
    classes = kept_table(
        prints.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.min("marks").alias("marks")), "classes"
    )
    half = F.expr(f"transform(sequence(0, {HALVES - 1}), i -> xxhash64(i, substring(marks, i * {4 * ROWS} + 1, {4 * ROWS})))")
    halves = classes.select("set_key", F.explode(half).alias("half"))
    shared = kept_table(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "halves", bag)
    mine = halves.join(shared, "half", "left_semi").groupBy("set_key").agg(F.sort_array(F.collect_list("half")).alias("h")).where("size(h) > 1")
    tables = F.expr("flatten(transform(sequence(1, size(h) - 1), i -> transform(slice(h, i + 1, size(h) - i), x -> xxhash64(h[i - 1], x))))")
    keyed = mine.select(F.col("set_key").alias("id"), F.explode(tables).alias("bucket"))
    buckets = kept_table(keyed, "buckets", bag)
    several = kept_table(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "several", bag)
    buckets = kept_table(buckets.join(several, "bucket", "left_semi"), "shared", bag)
    side = classes.select("set_key", "n", "marks")
    agree = F.expr(f"size(filter(sequence(0, {HALVES * ROWS - 1}), i -> substring(p, i * 4 + 1, 4) = substring(q, i * 4 + 1, 4)))")

    def full_sets(of: DataFrame) -> DataFrame:
        texts = maybe_in(docs, F.col("doc_id"), of, "doc_id").join(of.withColumnRenamed("doc_id", "least"), F.col("doc_id").eqNullSafe(F.col("least"))).select("set_key", "text")
        return texts.mapInArrow(_sets(size), "set_key binary, members binary").where("members is not null").dropDuplicates(["set_key"])

    def near(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(side.toDF("a", "n", "p"), "a").join(side.toDF("b", "m", "q"), "b")
        # Sets at the threshold agree in 24 of 32 MinHashes on average, and in fewer than 11 with a chance of 1e-7.
        return sized.where((100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (agree >= 11)).select("a", "b")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return full.mapInArrow(_confirm(percent), "a binary, b binary")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()

    def named_texts(keys: DataFrame) -> DataFrame:
        return keys.join(classes, "set_key").select(F.col("least").alias("doc_id"), "set_key")

    first = kept_table(near(_representative_pairs(buckets, bag)), "near", bag)
    sets = kept_table(full_sets(named_texts(ends(first))), "sets", bag)
    roots = components(kept_table(confirmed(first, sets), "confirmed", bag))
    rows = buckets.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("comp"))
    kinds = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket", "n")
    mixed = kept_table(rows.join(kinds, "bucket"), "mixed", bag)
    if not mixed.isEmpty():
        clusters = _clusters(mixed, bag)
        second = kept_table(near(_small_pairs(mixed, clusters)), "near2", bag)
        wanted = ends(second).union(clusters.select("id")).distinct().join(sets.select("set_key"), "set_key", "left_anti")
        sets = sets.unionByName(kept_table(full_sets(named_texts(wanted)), "sets2", bag))
        members = clusters.join(sets.withColumnRenamed("set_key", "id"), "id").withColumn("n", F.length("members") / 8)
        new = kept_table(confirmed(second, sets).unionByName(_rest_links(members, percent, bag)), "links2", bag)
        if not new.isEmpty():
            roots = _merged(roots, new, "roots2")
    discard(docs.sparkSession, bag)
    named = classes.join(roots.withColumnRenamed("id", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.drop("marks"), named.join(least, "root").select("set_key", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Links: 100 * shared shingles >= ``percent`` * all shingles of both. A text without words (or null) has an empty
    set and links with nothing. Repeated rows come out repeatedly, with the same component. A null id takes part and
    gets the least id that is not null of its component. Other columns are ignored. An empty table gives an empty one.
    """
    rows, found = _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), size, percent)
    out = rows.join(found, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component of near-duplicates, with all columns of ``docs`` as they are.

    Rows count by id and content, so rows that share an id, null included, are rows of their own. Of a component the
    row with the least id stays, null ids last; of several with that id the one whose content hashes least. Rows with
    an empty set of shingles all stay. Columns may have any name.
    """
    others = [F.col(c).cast("string") for c in docs.columns if c != text_col]
    mark = F.concat(F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.hex(F.xxhash64(*others)))
    own = F.col(id_col).cast("long")
    rows, found = _components(docs.select(own.alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text")), size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    named = rows.where("set_key is not null").join(found.select("set_key", "root"), "set_key")
    stay = named.groupBy("root").agg(first).select("first.doc_id", "first.mark", F.lit(False).alias("empty"))
    stay = stay.unionByName(rows.where("set_key is null").select("doc_id", "mark", F.lit(True).alias("empty")).distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own_id"), mark.alias("own_mark"))
    kept = packed.join(stay, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark")))
    # Rows equal in all columns are one row here.
    one = kept.where(~F.col("empty")).dropDuplicates(["own_id", "own_mark"])
    return one.unionByName(kept.where("empty")).select("row.*")
