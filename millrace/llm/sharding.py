"""Operator 5, sharding: longest-processing-time scheduling of groups of equal texts.

Groups, largest first, go to the least-loaded shard. Groups of one size are interchangeable, so the
heap works on the histogram of group sizes: a run of c equal groups is dealt in one step (filled to
a common level, the rest through the heap), which gives the loads of dealing them one by one. Sizes keep
``size_bits`` leading bits and a class's groups count with the class's mean size. A group's own size is within 2**(1 - size_bits)
of that, as a share of it, and so is a shard's load of the load that was planned (0.025 % for 13 bits); sizes that
have no more bits are exact. That bounds the histogram at 2**(size_bits - 1) rows per doubling of the
size, whatever the input, so it is all that reaches the driver.

Each group is then found its shard by its rank in its class, and each document its slot, with ranks
that are computed in buckets (see ``shared.with_rank``).

Defined cases: a null text has size 8, no text_crc32 and counts as one text, like an empty one
(another group). Repeated rows are rows of their group with slots of their own. Groups of equal size and shards of equal
load go in order, to the lowest shard first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, partitions, with_rank

SIZE_BITS = 13
#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def fill(loads: list[int], size: float, count: int) -> list[int]:
    """How many of ``count`` groups of equal size each shard gets when each goes to the least-loaded one.

    Up to a common level all shards take what fits under it; what is left, fewer than one a shard,
    goes through a heap of (load, shard).
    """
    given = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), max(loads) + size * (count + 1)
        under = lambda level: [max(0, -int(-(level - x) // size)) for x in loads]
        for _ in range(200):
            level = (low + high) / 2
            if sum(under(level)) <= count:
                low, given = level, under(level)
            else:
                high = level
            if high - low < size / 4 and count - sum(given) <= len(loads):
                break
    heap = [(x + size * n, i) for i, (x, n) in enumerate(zip(loads, given, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, i = heapq.heappop(heap)
        given[i] += 1
        heapq.heappush(heap, (load + size, i))
    return given


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For (class, groups, bytes) rows: where each shard's share of a class ends, counted in groups."""
    loads: list[float] = [0.0] * shards
    plan = []
    for kind, count, total in sorted(classes, reverse=True):
        given = fill(loads, total / count, count)
        ends, at = [], 0
        for i, n in enumerate(given):
            loads[i] += n * total / count
            at += n
            ends.append(at)
        plan.append((kind, ends))
    return plan


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 500_000, size_bits: int = SIZE_BITS) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes; equal texts stay together.

    Returns the id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    digests = scratch.write(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("00"))).alias("__group"),
            # Deals out rows that have all in common. It is written here, so it stays what it is when a task runs again.
            F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int").alias("__salt"),
        ),
        "digests",
    )
    total = F.sum("size")
    # The class: the size with all but its leading bits cleared.
    low_bits = F.greatest(F.lit(0), F.length(F.bin(F.col("__bytes"))) - size_bits)
    groups = scratch.write(
        digests.groupBy("__group")
        .agg(total.alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__class", F.call_function("shiftleft", F.call_function("shiftright", F.col("__bytes"), low_bits), low_bits)),
        "groups",
    )
    classes = groups.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("bytes"), F.sum("__rows").alias("rows")).toPandas()
    plan = schedule([(int(k), int(n), int(b)) for k, n, b in classes[["__class", "n", "bytes"]].itertuples(index=False)], shards)
    # At most 2**(size_bits - 1) classes a doubling: a bounded table, safe to broadcast.
    ends = spark.createDataFrame(pd.DataFrame(plan or None, columns=["__class", "__ends"]), "__class long, __ends array<long>")

    buckets = max(4, -(-int(classes["n"].max() if len(classes) else 0) // rows_per_bucket))
    ranked = with_rank(groups.select("__group", "__class"), ["__class"], [F.col("__group")], "__rank", buckets, F.xxhash64("__group"))
    placed = scratch.write(
        ranked.join(F.broadcast(ends), "__class").select(
            F.col("__group").alias("__placed"), F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int").alias("shard")
        ),
        "placed",
    )
    rows = int(classes["rows"].sum()) if len(classes) else 0
    buckets = max(4 * partitions(spark) // shards + 4, -(-rows // (shards * rows_per_bucket)))
    located = scratch.write(digests.join(placed, F.col("__group") == F.col("__placed")).select(id_col, "size", "text_crc32", "shard", "__salt"), "located")
    numbered = with_rank(located, ["shard"], [F.col(id_col), F.col("text_crc32")], "slot", buckets, F.xxhash64(id_col, "text_crc32", "__salt"))
    return numbered.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
