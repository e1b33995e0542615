"""What the corpus operators share: intermediate tables, gapless ranks, bitmaps and small helpers.

Intermediate results that several steps read are written as Parquet under
``spark.checkpoint.dir`` (a folder that every executor and the driver see), so
that a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.sources.scratch import scratch_path

MAX_BITMAP_BITS = 26
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator call, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write a table and return it as read back: its lineage is then one scan.

        Spark deletes the shuffle files of this write when it ends, instead of when the driver's collector finds them unused: nothing reads them again.
        """
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(label))
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more."""
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables."""
        self.drop(".")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def longs(values: list[int]) -> Column:
    """An array of longs as one literal, however many there are: it is parsed once, when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` has at most so many bytes, or of one row."""
    for batch in batches:
        start = size = 0
        for i, x in enumerate(batch.column(column)):
            more = len(x.as_buffer()) if x.is_valid else 0
            if i > start and size + more > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += more
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


def trimmed(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that hands freed memory back when it ends.

    Spark keeps Python workers from task to task, and allocators keep what was freed in them: idle memory of one stage would add to the next one's.
    """

    @wraps(make)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
                trim(0)

    return run


def bit_of(h: Column, bits: int) -> tuple[Column, Column]:
    """The word of a bitmap that a hash falls into, and its bit there."""
    at = F.shiftrightunsigned(h, 64 - bits)
    return F.shiftrightunsigned(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(hashes: DataFrame, column: str, count: int, most: int = MAX_BITMAP_BITS) -> tuple[DataFrame, int]:
    """((word, bits) rows, log2 of its length): at most 2**most bits, whatever the count."""
    bits = min(most, max(10, ceil(log2(max(count, 1))) + 4))
    word, bit = bit_of(F.col(column), bits)
    return hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), bits


def maybe_among(rows: DataFrame, id_col: str, ids: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``rows`` with ``__maybe``: whether ``id_col`` may be among the column ``id`` of ``ids``, by a broadcast bitmap of bounded size.

    Rows that can't be are spared a shuffle; a join has to tell the rest apart.
    """
    hashed = scratch.write(ids.select(F.xxhash64("id").alias("h")), label)
    marks, bits = bitmap(hashed, "h", hashed.count())
    word, bit = bit_of(F.xxhash64(id_col), bits)
    marks = marks.select(F.col("word").alias("__of"), F.col("bits").alias("__bits"))
    return (
        rows.withColumn("__word", word)
        .join(F.broadcast(marks), F.col("__word") == F.col("__of"), "left")
        .withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)))
        .drop("__word", "__of", "__bits")
    )


def with_rank(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int, spread: Column) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in buckets so that no task holds a whole key.

    ``spread`` deals a key's rows to ``buckets`` buckets; rows are numbered in each bucket and the
    buckets' starts come from a running sum over the (key, bucket) counts. The order within a key is
    by bucket, then ``order``.
    """
    df = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    by = [*keys, "__bucket"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(W.Window.partitionBy(*by).orderBy(*order)) - 1
    return (
        df.withColumn("__local", local)
        .join(starts, by)
        .withColumn(out, (F.col("__start") + F.col("__local")).cast("long"))
        .drop("__bucket", "__local", "__start")
    )
