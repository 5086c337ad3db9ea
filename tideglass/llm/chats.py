"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are rendered.

Turns get hashes of (place, role, text); running exclusive-ors of them are prefix hashes. A conversation whose whole
hash and length equal a proper prefix of a longer one is dropped by an anti join; of equal ones the least id stays.
DataFrame functions only. Turns are numbered in buckets of their turn value, so no task sorts a whole conversation,
and a long conversation is rendered in parts of ``PART_TURNS`` turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import kept_table

BUCKET = 256
PART_TURNS = 512


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, role, text, h1, h2``: turns in order with their prefix hashes; equal rows count once.

    Order: turn (null first), then role and text (null first). Nulls of role and text stay nulls and are hashed apart
    from empty strings.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = rows.withColumn("bucket", F.floor(F.coalesce("turn", F.lit(-(2**62))) / BUCKET).cast("long"))
    inside = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("inner", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), "base")
    placed = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b"))).withColumn("place", F.col("inner") + F.col("base"))
    one = F.struct(F.col("role").isNull(), F.col("text").isNull())
    placed = placed.select("conv_id", "place", "bucket", "role", "text", F.xxhash64("place", one, "role", "text").alias("t1"), F.xxhash64(F.lit("second"), "place", one, "text", "role").alias("t2"))
    placed = placed.withColumn("part", F.floor((F.col("place") - 1) / PART_TURNS))
    near = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv_id", "part", "place", "role", "text", F.bit_xor("t1").over(near).alias("x1"), F.bit_xor("t2").over(near).alias("x2"))
    ends = placed.groupBy("conv_id", "part").agg(F.max_by(F.struct("x1", "x2"), "place").alias("x"))
    far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.bit_xor("x.x1").over(far), F.lit(0)).alias("y1"), F.coalesce(F.bit_xor("x.x2").over(far), F.lit(0)).alias("y2"))
    joined = placed.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", "part", "place", "role", "text", F.col("x1").bitwiseXOR(F.col("y1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("h2"))


def render(role, text):
    """A turn as ``<|role|>``, line break, text, line break; nulls are empty, an unknown role is ``user``."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """``conv_id, part, n_turns, copies, rendered``: the maximal conversations, in parts of ``PART_TURNS`` turns.

    ``n_turns`` is the length of the whole conversation, ``copies`` the number of equal ones, of which the least id is
    named. Conversations that are proper prefixes of others are left out. Rows with a null conversation id form one
    conversation, which comes last among equal ones. Extra columns are ignored; an empty table gives an empty one.
    """
    placed = kept_table(placed_turns(turns, **columns), "turns")
    long = placed.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    named = long.select(F.col("conv_id").alias("c"), "n_turns")
    last = placed.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("n_turns")))
    whole = last.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # Prefixes are counted once each before they meet, so a first turn that very many share is one row.
    proper = placed.join(named, F.col("conv_id").eqNullSafe(F.col("c"))).where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("c"), "n_turns", "copies")
    own = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    lines = F.sort_array(F.collect_list(F.struct("place", render(F.col("role"), F.col("text")).alias("line"))))
    parts = own.groupBy("conv_id", "part", "n_turns", "copies").agg(lines.alias("lines"))
    return parts.select("conv_id", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
