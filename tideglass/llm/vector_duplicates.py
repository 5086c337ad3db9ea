"""Near-duplicate vectors by robust-pruned graphs on overlapping cluster shards.

Equal vectors are one class. Centres come from a bounded sample; every class goes to the shards of its ``OVERLAP``
nearest centres. A shard of more than ``BLOCK`` classes is dealt out over blocks, and pairs of blocks are searched
apart, so a task holds two blocks at most whatever the data. In each a graph is built and searched from its medoids;
dot products in double precision decide. A pair that several shards hold is counted in the least of them. Tasks give
link counts and spanning links, not pairs. A sample of the vectors is compared with all to audit recall.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import kept_table
from tideglass.llm.components import components
from tideglass.llm.vector_graph import build, range_search

#: Bounds of the sample for the centres, of the centres, and of the audited vectors.
SAMPLE_ROWS = 32_768
MOST_CENTRES = 8_192
AUDIT_ROWS = 128
PER_CENTRE = 400
OVERLAP = 3
BLOCK = 2_048


def _unit(values) -> np.ndarray | None:
    if values is None:
        return None
    x = np.array([np.nan if v is None else v for v in values], float)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 4_096) for i in range(0, batch.num_rows, 4_096)):
            units = [_unit(v) for v in part.column("vector").to_pylist()]
            raw = [None if u is None else u.astype("<f8").tobytes() for u in units]
            keys = [None if r is None else hashlib.md5(r).digest() for r in raw]
            yield pa.record_batch([part.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "unit"])


def centres(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Unit centres of ``count`` clusters of a bounded sample, by spherical k-means from random rows."""
    found = sample[np.random.default_rng(3).permutation(len(sample))[:count]]
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 2_048] @ found.T).argmax(axis=1) for a in range(0, len(sample), 2_048)])
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        found = np.where(size > 0, total / np.maximum(size, 1e-12), found)
    return found


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _search(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, i, j = (k.as_py() for k in key)
        x, sizes, block = _stack(table["unit"]), table["size"].to_numpy(), table["block"].to_numpy()
        shards, keys = table["shards"].to_pylist(), table["key"].to_pylist()
        if i == j:
            a, b = range_search(x, build(x), x, least, np.arange(len(x)))
            left = right = np.arange(len(x))
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = range_search(x[right], build(x[right]), x[left], least) if len(left) and len(right) else (left[:0], left[:0])
        a, b = left[a], right[b]
        a, b = a[a != b], b[a != b]
        if i == j:  # a pair may be found from one side only
            pairs = np.unique(np.minimum(a, b).astype(np.int64) * len(x) + np.maximum(a, b))
            a, b = pairs // len(x), pairs % len(x)
        width = max(map(len, shards))
        own = np.array([s + [-(10**9) - k] * (width - len(s)) for k, s in enumerate(shards)])
        # The pair counts here if no lesser shard has both.
        counts = np.zeros(len(x), np.int64)
        for at in range(0, len(a), 100_000):
            p, q = a[at : at + 100_000], b[at : at + 100_000]
            both = (own[p][:, :, None] == own[q][:, None, :]).any(axis=2)
            first = np.where(both, own[p], 2**60).min(axis=1) == shard
            counts += np.bincount(p[first], sizes[q[first]], len(x)).astype(np.int64) + np.bincount(q[first], sizes[p[first]], len(x)).astype(np.int64)
        root = np.arange(len(x))
        while True:  # least reachable row, by halving
            up = root.copy()
            np.minimum.at(up, a, root[b])
            np.minimum.at(up, b, root[a])
            up = up[up]
            if (up == root).all():
                break
            root = up
        out = np.flatnonzero((counts > 0) | (root != np.arange(len(x))))
        return pa.table([pa.array([keys[k] for k in out], pa.binary()), pa.array(counts[out]), pa.array([keys[k] for k in root[out]], pa.binary())], names=["key", "links", "root"])

    return run


def near_vectors(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept, audit_recall`` for every row.

    Vectors that are null, zero, empty or hold a null or non-finite component link with nothing; neither do vectors of
    different lengths. Repeated rows are vectors of their own. A null id takes part; components are named by the least
    id that is not null. ``audit_recall`` is the share of links that the sample's brute-force comparison finds too.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    parsed = kept_table(rows.mapInArrow(_parse, "vec_id long, key binary, unit binary"), "vectors")
    classes = kept_table(parsed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("unit").alias("unit")).withColumn("dim", F.length("unit") / 8), "classes")
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).first()
    none = parsed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    if dims is None:
        return none
    count = int(min(MOST_CENTRES, max(1, dims.n // PER_CENTRE)))
    drawn = classes.where(F.col("dim") == dims.dim).orderBy(F.xxhash64("key"), "key")
    sample = _stack(pa.array([r.unit for r in drawn.select("unit").limit(SAMPLE_ROWS).collect()], pa.binary()))
    shared = spark.sparkContext.broadcast(centres(sample, count))
    # Centres of other lengths are not learned: all vectors of one such length are a shard.
    width = int(dims.dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        keep = min(OVERLAP, len(found))
        for batch in batches:
            for part in (batch.slice(i, 2_048) for i in range(0, batch.num_rows, 2_048)):
                units = part.column("unit").to_pylist()
                at = [k for k, u in enumerate(units) if len(u) == 8 * width]
                shards = [[-(len(u) // 8)] for u in units]
                if at:
                    s = np.frombuffer(b"".join(units[k] for k in at), "<f8").reshape(len(at), -1) @ found.T
                    for k, row in zip(at, np.argpartition(-s, keep - 1, axis=1)[:, :keep].tolist(), strict=True):
                        shards[k] = sorted(row)
                yield pa.record_batch([*(part.column(c) for c in ("key", "size", "unit")), pa.array(shards, pa.list_(pa.int64()))], ["key", "size", "unit", "shards"])

    dealt = kept_table(classes.select("key", "size", "unit").mapInArrow(assign, "key binary, size long, unit binary, shards array<long>"), "dealt")
    members = dealt.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = members.withColumn("other", other).select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "size", "unit", "shards", "block")
    found = kept_table(meet.groupBy("shard", "i", "j").applyInArrow(_search(least), "key binary, links long, root binary"), "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    named = classes.select("key", "least", "size").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = kept_table(named.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("size") - 1), "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(names, "root").select("key", "n_links", "component_id")
    audited = drawn.limit(AUDIT_ROWS).select("key", "unit").collect()
    recall = _audit(classes, named, [(bytes(r.key), bytes(r.unit)) for r in audited], least)
    out = parsed.select("vec_id", "key").join(result, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).alias("audit_recall"))


def _audit(classes: DataFrame, named: DataFrame, sample: list[tuple[bytes, bytes]], least: float) -> float:
    """Share of the true links of a bounded sample, found by comparing it with all classes, that ``named`` counts."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(np.frombuffer(b"".join(u for _, u in sample), "<f8").reshape(len(sample), -1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        total = np.zeros(len(x), np.int64)
        for batch in batches:
            units, sizes = batch.column("unit").to_pylist(), batch.column("size").to_numpy()
            at = np.array([k for k, u in enumerate(units) if len(u) == 8 * x.shape[1]], int)
            if len(at):
                y = np.frombuffer(b"".join(units[k] for k in at), "<f8").reshape(len(at), -1)
                total += ((x @ y.T) >= least) @ sizes[at]
        yield pa.record_batch([pa.array(np.arange(len(x))), pa.array(total)], ["at", "n"])

    true = {r.at: r.n - 1 for r in classes.select("unit", "size").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    place = {k: i for i, (k, _) in enumerate(sample)}
    seen = {place[bytes(r.key)]: r.n_links for r in named.where(F.col("key").isin([bytearray(k) for k in place])).select("key", "n_links").collect()}
    whole = sum(max(0, n) for n in true.values())
    return float(sum(min(seen.get(i, 0), max(0, n)) for i, n in true.items()) / whole) if whole else 1.0
