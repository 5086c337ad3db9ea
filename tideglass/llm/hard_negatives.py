"""Hard negatives: vectors of other labels that score close below an anchor's positives, by exact inner-product search.

Equal vectors of one label are one candidate with its least ids, more of which no result can use. Candidates are dealt
to the nearest of some centres, large clusters in pieces, and every piece becomes a cover tree stored as a row. Blocks
of anchors descend all trees twice, best first: once for the positives, then for the score windows below them. Covering
angles bound the scores of a node, and nodes outside every window that can still gain are skipped; points are verified
exactly. Tasks give their few best rows, which meet per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import discard, kept_table
from tideglass.llm.cover_tree import CoverTree, build, descend

#: Candidates of a tree, centres and the sample they are drawn from, bytes of the anchors that are sent to the tasks.
TREE_ROWS = 2_048
MOST_CENTRES = 1_024
SAMPLE_ROWS = 8_192
ANCHOR_BYTES = 32_000_000


def _parse(scale: float):
    """Integer vectors as bytes; rows that take no part get null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4_096) for i in range(0, batch.num_rows, 4_096)):
                column = part.column("vector")
                x = np.floor(scale * column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
                cuts = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))))
                bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
                whole = (np.diff(cuts) > 0) & (np.diff(bad[cuts]) == 0)
                raw = [x[a:b].astype("<f8").tobytes() if ok else None for a, b, ok in zip(cuts[:-1], cuts[1:], whole, strict=True)]
                squares = np.concatenate(([0.0], np.cumsum(np.where(np.isfinite(x), x * x, 0.0))))
                yield pa.record_batch([*(part.column(c) for c in ("vec_id", "label", "anchor")), pa.array(raw, pa.binary()), pa.array(np.sqrt(np.maximum(0.0, np.diff(squares[cuts]))))], ["vec_id", "label", "anchor", "vector", "length"])

    return run


def _stack(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a bounded sample, each the farthest from those before it."""
    at, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < count and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _deal(shared, width: int):
    """Adds the nearest centre; vectors of another length than the centres go by their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        half = (found * found).sum(axis=1) / 2
        for batch in batches:
            for part in (batch.slice(i, 4_096) for i in range(0, batch.num_rows, 4_096)):
                raw = part.column("vector").to_pylist()
                shard = np.array([-len(v) // 8 for v in raw], np.int64)
                at = np.flatnonzero(shard == -width)
                if len(at):
                    shard[at] = (_stack([raw[i] for i in at]) @ found.T - half).argmax(axis=1)
                yield pa.record_batch([*part.columns, pa.array(shard)], [*part.schema.names, "shard"])

    return run


_TREE = "dim int, points binary, centre binary, angle binary, own binary, below binary, labels array<long>, ids array<array<long>>"


def _plant(reach: float):
    """A tree as one row, candidates in the order of its points."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vector", "ascending"), ("label", "ascending")])
        tree, order = build(_stack(table["vector"].to_pylist()), reach)
        members = table.select(["label", "ids"]).take(pa.array(order))
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (tree.points.astype("<f8"), tree.centre.astype("<f8"), tree.angle.astype("<f8"), tree.own.astype("<i8"), tree.below.astype("<i8"))]
        lists = [pa.array([members[c].to_pylist()], t) for c, t in (("label", pa.list_(pa.int64())), ("ids", pa.list_(pa.list_(pa.int64()))))]
        return pa.table([pa.array([tree.points.shape[1]], pa.int32()), *raw, *lists], names=["dim", "points", "centre", "angle", "own", "below", "labels", "ids"])

    return run


def _trees(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[tuple[int, CoverTree, np.ndarray, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            dim = row["dim"].as_py()
            grid = lambda c, t, w, row=row: np.frombuffer(row[c].as_buffer(), t).reshape(-1, w)
            tree = CoverTree(grid("points", "<f8", dim), grid("centre", "<f8", dim), grid("angle", "<f8", 1)[:, 0], grid("own", "<i8", 2), grid("below", "<i8", 2), reach)
            yield dim, tree, np.array(row["labels"].as_py(), np.int64), row["ids"].as_py()


class Best:
    """The ``k`` rows with the highest scores, ties by the least id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> float:
        """No row below this score can enter."""
        return self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def add(self, rows: list[tuple[int, int]]) -> None:
        if rows:
            self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1]))[: self.k]


def _positives(shared, reach: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared.value
        best = [Best(k) for _ in ids]
        for dim, tree, own, members in _trees(batches, reach):
            held = set(own.tolist())
            for a, (vec_id, label, vector) in enumerate(zip(ids, labels, vectors, strict=True)):
                if len(vector) != 8 * dim or label not in held:
                    continue
                top = best[a]

                def visit(at, scores, top=top, vec_id=vec_id, label=label):
                    use = np.flatnonzero((own[at] == label) & (scores >= top.least))
                    top.add([(int(scores[i]), other) for i in use for other in members[at[i]] if other != vec_id])

                descend(tree, np.frombuffer(vector, "<f8"), lambda low, high, top=top: high >= top.least, visit)
        yield _flat([(a, None, s, other) for a, top in enumerate(best) for s, other in top.rows])

    return run


def window(score: int, low_pct: int, high_pct: int) -> tuple[int, int]:
    """Whole scores s with low_pct * score <= 100 * s <= high_pct * score; empty if the ends are crossed."""
    return -(-low_pct * score // 100), high_pct * score // 100


def _negatives(shared, reach: float, wanted_scores, k: int, low_pct: int, high_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared.value
        frames = []
        for a in range(len(ids)):
            own = [(s, *window(s, low_pct, high_pct), Best(k)) for s in wanted_scores.value.get(a, ())]
            frames.append([f for f in own if f[1] <= f[2]])
        for dim, tree, own, members in _trees(batches, reach):
            for a, (label, vector, mine) in enumerate(zip(labels, vectors, frames, strict=True)):
                if len(vector) != 8 * dim or not mine:
                    continue

                def wanted(low, high, mine=mine):
                    found = np.zeros(len(low), bool)
                    for _, first, last, best in mine:
                        found |= (high >= max(first, best.least)) & (low <= last)
                    return found

                def visit(at, scores, label=label, mine=mine):
                    other = own[at] != label
                    for _, first, last, best in mine:
                        use = np.flatnonzero(other & (scores >= max(first, best.least)) & (scores <= last))
                        if len(use) > k:  # only the highest scores matter, with all ties of the last of them
                            least = np.partition(scores[use], len(use) - k)[len(use) - k]
                            use = use[scores[use] >= least]
                        best.add([(int(scores[i]), m) for i in use for m in members[at[i]][:k]])

                descend(tree, np.frombuffer(vector, "<f8"), wanted, visit)
        yield _flat([(a, s, score, other) for a, mine in enumerate(frames) for s, _, _, best in mine for score, other in best.rows])

    return run


def _flat(rows: list[tuple]) -> pa.RecordBatch:
    a, s, score, other = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(a, pa.int32()), pa.array(s, pa.int64()), pa.array(score, pa.int64()), pa.array(other, pa.int64())], ["at", "positive_score", "score", "other_id"])


_FOUND = "at int, positive_score long, score long, other_id long"


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tree_rows: int = TREE_ROWS,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x), scores are inner products of these in whole numbers (exact up to 2^63; scores
    are only defined between vectors of one length). Rows with a null id, label or vector, with no component, or with a
    null or non-finite one take no part. The positives of an anchor are its first ``positives`` rows with its label and
    another id; each is given with the first ``negatives`` rows of other labels whose score is between ``low_pct`` and
    ``high_pct`` per cent of its own. Higher scores come first, ties by the least id. Rows repeated in id, label and
    vector count once; rows that share an id otherwise are rows of their own, as anchors too. Other columns are not read
    but by ``anchors``, a condition on the rows. Without anchors or candidates the result is empty.
    """
    spark = table.sparkSession
    bag: list[str] = []
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    parsed = rows.where("vec_id is not null and label is not null and vector is not null").mapInArrow(_parse(scale), "vec_id long, label long, anchor boolean, vector binary, length double")
    parsed = kept_table(parsed.where("vector is not null"), "parsed", bag)
    one = parsed.groupBy("vec_id", "label", "vector").agg(F.max("anchor").alias("anchor"), F.max("length").alias("length"))
    # Of equal vectors with one label only the least ids can be in a result, one more for the anchor itself.
    most = max(positives + 1, negatives)
    least = Window.partitionBy("vector", "label").orderBy("vec_id")
    few = one.withColumn("place", F.row_number().over(least)).where(F.col("place") <= most)
    classes = kept_table(few.groupBy("vector", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("length").alias("length")), "candidates", bag)
    sizes = classes.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n"), F.max("length").alias("reach")).orderBy(F.desc("n"), "bytes")
    largest = sizes.first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if largest is None:
        return empty
    reach = float(classes.agg(F.max("length")).first()[0]) * (1 + 1e-9) + 1e-6
    drawn = classes.where(F.length("vector") == largest.bytes).orderBy(F.xxhash64("vector"), "vector", "label").select("vector").limit(SAMPLE_ROWS).collect()
    centres = _centres(_stack([bytes(r.vector) for r in drawn]), int(min(MOST_CENTRES, -(-largest.n // tree_rows))))
    dealt = classes.select("vector", "label", "ids").mapInArrow(_deal(spark.sparkContext.broadcast(centres), int(largest.bytes // 8)), "vector binary, label long, ids array<long>, shard long")
    dealt = kept_table(dealt, "dealt", bag)
    pieces = dealt.groupBy("shard").agg(F.ceil(F.count("*") / tree_rows).alias("pieces"))
    placed = dealt.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("vector", "label"), F.col("pieces")))
    trees = kept_table(placed.groupBy("shard", "piece").applyInArrow(_plant(reach), _TREE), "trees", bag)

    asked = one.where("anchor")
    load = asked.agg(F.sum(F.length("vector") + 64)).first()[0] or 0
    blocks = -(-load // anchor_bytes)
    out = empty
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "label", "vector").toArrow().sort_by([("vec_id", "ascending"), ("label", "ascending"), ("vector", "ascending")])
        shared = spark.sparkContext.broadcast(tuple(own[c].to_pylist() for c in ("vec_id", "label", "vector")))
        found = kept_table(_first(trees.mapInArrow(_positives(shared, reach, positives), _FOUND), positives, "at"), "positives", bag)
        scores: dict[int, set] = {}
        for r in found.select("at", "score").distinct().collect():  # at most ``positives`` rows for an anchor of the block
            scores.setdefault(r.at, set()).add(r.score)
        wanted = spark.sparkContext.broadcast({a: sorted(s) for a, s in scores.items()})
        near = _first(trees.mapInArrow(_negatives(shared, reach, wanted, negatives, low_pct, high_pct), _FOUND), negatives, "at", "positive_score")
        names = spark.createDataFrame(pa.table([pa.array(range(own.num_rows), pa.int32()), own["vec_id"]], names=["at", "anchor_id"]))
        left = found.select("at", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        right = near.select("at", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = left.join(right, ["at", "positive_score"]).join(names, "at")
        out = out.unionByName(kept_table(pairs.select(*empty.columns), "hard-negatives"))
    discard(spark, bag)
    return out
