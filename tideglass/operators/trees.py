"""Explanation of boosted trees by their decision paths.

A stored model is a table of nodes, each with the mean prediction of the rows that reached it in training. Going down a
tree, the change from a node to its child is due to the feature the node splits on. Every leaf therefore stands for one
vector of contributions; those of the leaves that a row ends in add up to its score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators.forecast import top_k_features
from tideglass.session import scratch_path

#: Largest table of leaf contributions that is sent to the tasks.
LEAF_BYTES = 256_000_000


def tree_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """``tree, node, prediction, feature, left, right, weight`` of all nodes; leaves have a ``feature`` below 0."""
    path = scratch_path(spark, "trees")
    model.save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
    )
    return nodes.join(weights, "tree")


@dataclass
class LeafTable:
    """``rows[first[t] + leaf]`` are the weighted contributions of a leaf of tree ``t``; ``base`` is the score before any split."""

    first: np.ndarray
    rows: np.ndarray
    base: float


def leaf_contributions(spark: SparkSession, model: GBTClassificationModel) -> LeafTable:
    """From the node table, which is as large as the model; leaves are numbered from left to right."""
    trees: list[dict] = [{} for _ in model.treeWeights]
    for r in tree_nodes(spark, model).collect():
        trees[r.tree][r.node] = r
    leaves = sum(n.feature < 0 for t in trees for n in t.values())
    if leaves * model.numFeatures * 8 > LEAF_BYTES:
        raise ValueError("the model has more leaves than can be sent to the tasks")
    rows, first, base = np.zeros((leaves, model.numFeatures)), [], 0.0
    at = 0
    for nodes in trees:
        first.append(at)
        base += nodes[0].weight * nodes[0].prediction
        todo = [(0, np.zeros(model.numFeatures))]
        while todo:
            node, path = todo.pop()
            own = nodes[node]
            if own.feature < 0:
                rows[at] = path
                at += 1
                continue
            for child in (own.right, own.left):  # the left one is taken up first
                onward = path.copy()
                onward[own.feature] += own.weight * (nodes[child].prediction - own.prediction)
                todo.append((child, onward))
    return LeafTable(np.array(first), rows, base)


def explain_trees(df: DataFrame, model: GBTClassificationModel, names: Sequence[str], features: str = "features", k: int = 8) -> DataFrame:
    """Adds ``base``, ``contributions`` (one per feature), their ``score`` and the ``top`` features by size.

    ``base`` and the contributions add up to ``score``, the margin of the positive class. Rows are not moved: the leaf
    of every tree is found by the model, and a task looks its contributions up in the broadcast leaf table.
    """
    spark = df.sparkSession
    table = leaf_contributions(spark, model)
    shared, width = spark.sparkContext.broadcast(table), len(table.first)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            leaves = batch.column("_leaves").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
            out = np.concatenate([own.rows[own.first + part].sum(axis=1) for part in np.array_split(leaves, len(leaves) // 512 + 1)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_leaves"]
            yield pa.record_batch([*columns, lists], [*(n for n in batch.schema.names if n != "_leaves"), "contributions"])

    kept = [c for c in df.columns if c != features]
    fresh = model.copy()
    for setter, name in ((fresh.setLeafCol, "_leaf"), (fresh.setPredictionCol, ""), (fresh.setProbabilityCol, ""), (fresh.setRawPredictionCol, "_raw")):
        setter(name)
    scored = fresh.transform(df).select(*kept, vector_to_array("_raw")[1].alias("score"), vector_to_array("_leaf").alias("_leaves"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.drop("_leaves").schema)
    out = scored.mapInArrow(look_up, f"{kinds}, contributions array<double>")
    sizes = F.transform("contributions", lambda c: F.abs(c))
    return out.withColumns({"base": F.lit(table.base), "top": top_k_features(sizes, names, k)})
