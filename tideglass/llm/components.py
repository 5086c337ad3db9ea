"""Connected components of links between rows, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import discard, kept_table


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id in the columns ``a`` and ``b`` of ``links``; ids of a component share a root.

    Each round joins every vertex to the neighbour (or itself) whose hash is least and contracts the graph, which
    leaves a constant share of the vertices however long the chains are. Minima are taken before the shuffle, so a
    vertex with very many links is no burden. Self links, repeated links and nulls add nothing.
    """
    bag: list[str] = []
    edges = kept_table(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links", bag)
    roots, step = None, 0
    while not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("id"), rank("b").alias("r")).unionAll(edges.select(F.col("b").alias("id"), rank("a").alias("r")))
        least = both.groupBy("id").agg(F.min("r").alias("r"))
        up = kept_table(least.select("id", F.least("r", rank("id"))["v"].alias("up")), f"up{step}", bag)
        edges = kept_table(
            edges.join(up.select(F.col("id").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"edges{step}",
            bag,
        )
        joined = up if roots is None else roots.join(up.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        roots = kept_table(joined.select("id", F.col(joined.columns[1]).alias("root")), f"roots{step}", bag)
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    bag.pop()  # the last table is the result
    discard(links.sparkSession, bag)
    return roots
