"""Helpers of the corpus operators: shared intermediate tables and a row check."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.session import scratch_path

#: Bytes of text that a numpy step of a task looks at together, unless one text is longer.
BLOCK_BYTES = 4_000_000


#: Bytes of the rows that Spark hands to a Python worker together, unless one row is longer.
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes from here on; without it 10,000 rows go together, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers live on while the JVM does other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def kept_table(df: DataFrame, name: str, bag: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage. ``bag`` takes the path for :func:`discard`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if bag is not None:
        bag.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, bag: list[str]) -> None:
    """Delete tables that nothing reads anymore."""
    while bag:
        path = spark._jvm.org.apache.hadoop.fs.Path(bag.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    """The same rule in Python."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece hold about ``limit`` bytes; no text is cut.

    After the last piece, freed memory goes back to the system.
    """
    for batch in batches:
        texts = batch.column(column)
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


#: Bits of the table in :func:`maybe_in`: at most 2^18 rows of two numbers are broadcast.
TABLE_BITS = 24


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted[column]``: all that are, few others while these are few.

    Spares the shuffle of long rows before a join. The table of hash bits that is broadcast has a fixed size; where
    it is full, more rows pass, and the join decides anyway.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c, F.lit("maybe")), 64 - TABLE_BITS)
    bits = wanted.select(slot(F.col(column)).alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_bits"))
    inside = F.expr("shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1")
    marked = df.withColumn("_slot", slot(key)).withColumn("_word", F.shiftright("_slot", 6))
    return marked.join(F.broadcast(bits), "_word").where(inside == 1).select(*df.columns)
