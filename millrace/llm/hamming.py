"""Operator 4, exact top-k search of binary codes: incremental multi-index hashing.

A vector's code has one bit a dimension: whether it is above zero. Codes are cut into m segments, and an index has a
row for each code and segment. In round r every open query looks up the values at distance exactly r from its
own in each segment; a code is met in the round of its nearest segment, at the first such segment, so no pair is
verified twice. After round r, whatever was not met differs by more than r bits in each segment, hence by
m * (r + 1) or more; a query is closed when its kth verified distance is below that. As soon as a query has k
codes, their worst distance also says how many segments the next round still needs and which codes can improve it.

Probes are made in the tasks, a bounded number at a time. A query far from everything would need more probes
in a round than there are codes; queries that are still open then are compared with all codes, in blocks of queries, each task
keeping the k nearest over all its codes. The probes of a round are sent to the index if a bound on their number is small, so that
the index stays where it is; else both are shuffled by segment and value.

Only distinct codes are searched, each with its k smallest ids, so many equal vectors cost no more than k.
m minimises probes plus expected candidates for the number of codes.

Defined cases: vectors that are null, of another length or with a null element have no code: they are
neither found nor answered. Rows without id are not found. Repeated rows are found as often as they stand. Ties
go to the smaller id. With fewer than k rows all are found. A query finds itself, too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from millrace.llm.shared import Scratch

BITS = 64
#: What a probe costs, in candidates: it is made, shuffled and looked up.
PROBE_COST = 20
#: Probes that a task makes at a time, and open queries that are compared with all codes at a time.
PROBES, QUERIES = 1 << 16, 1 << 14
#: Probes of a round that are sent to the index, instead of shuffling both.
SENT_PROBES = 1 << 20


def code_of(vector: Column, bits: int = BITS) -> Column:
    """The signs of a vector's elements, the first in the lowest bit; null for vectors without a code."""
    one = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << BITS) * (i == BITS - 1)).cast("long")).otherwise(F.lit(0).cast("long"))
    fit = (F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(fit, reduce(lambda a, b: a.bitwiseOR(b), map(one, range(bits))))


def widths(segments: int, bits: int = BITS) -> list[int]:
    return [bits // segments + (i < bits % segments) for i in range(segments)]


def choose_segments(codes: int, k: int, bits: int = BITS) -> int:
    """The m of least cost a query, if codes were uniform: a probe is a row of a join, a candidate a comparison in it."""
    ball, reach = 0, -1
    while reach < bits and codes * ball < k << bits:
        reach += 1
        ball += comb(bits, reach)

    def cost(m: int) -> float:
        probes = [sum(comb(w, r) for r in range(min(w, reach // m) + 1)) for w in widths(m, bits)]
        return sum(PROBE_COST * p + codes * p / 2**w for p, w in zip(probes, widths(m, bits), strict=True))

    return min(range(1, 17), key=cost)


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))


def probes_of(looking: DataFrame, radius: int, size: list[int]) -> DataFrame:
    """(query, worst, at, probe): the values at distance ``radius`` from each row's (seg, value)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, worst, seg, value = (batch.column(c).to_numpy() for c in ("query", "worst", "seg", "value"))
            for s in np.unique(seg):
                own = np.flatnonzero(seg == s)
                choices = combinations(range(size[s]), radius)
                while chunk := list(islice(choices, max(1, PROBES // len(own)))):
                    bits = np.array(chunk, np.uint64).reshape(len(chunk), radius)
                    masks = np.left_shift(np.uint64(1), bits).sum(axis=1, dtype=np.uint64).view(np.int64)
                    row = np.repeat(own, len(masks))
                    columns = [query[row], worst[row], seg[row], (value[own, None] ^ masks[None, :]).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "worst", "at", "probe"])

    return looking.mapInArrow(make, "query long, worst int, at int, probe long")


def nearest_of(codes: DataFrame, asked: np.ndarray, k: int) -> DataFrame:
    """(query, code, first, distance): of each task's codes the k nearest to each query, kept over all its batches."""
    shared = codes.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held, kind = shared.value, None, None
        for batch in batches:
            code, first = batch.column("code").to_numpy(), batch.column("first").to_numpy(zero_copy_only=False)
            if held is None and len(first):
                kind = batch.column("first").type
                held = np.full((len(asked), k), BITS + 1, np.int32), np.zeros((len(asked), k), np.int64), np.full((len(asked), k), first[0], first.dtype)
            order = np.argsort(first, kind="stable")
            for at in range(0, len(asked), 256) if len(first) else ():
                some = slice(at, at + 256)
                apart = np.bitwise_count((asked[some, None] ^ code[None, order]).view(np.uint64))
                # Equal distances keep the order of ids.
                near = np.argsort(apart, axis=1, kind="stable")[:, :k]
                picked = order[near]
                new = np.take_along_axis(apart, near, 1).astype(np.int32), code[picked], first[picked]
                both = [np.concatenate([h[some], x], axis=1) for h, x in zip(held, new, strict=True)]
                rank = np.unique(both[2], return_inverse=True)[1].reshape(both[2].shape)
                best = np.lexsort((rank, both[0]), axis=1)[:, :k]
                for h, x in zip(held, both, strict=True):
                    h[some] = np.take_along_axis(x, best, 1)
        if held is not None:
            real = held[0] <= BITS
            row = np.repeat(asked, k).reshape(real.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[real]), pa.array(held[1][real]), pa.array(held[2][real], kind), pa.array(held[0][real])], names=["query", "code", "first", "distance"]
            )

    rows = codes.select("code", F.col("ids")[0].alias("first"))
    fields = [T.StructField("query", T.LongType()), T.StructField("code", T.LongType()), rows.schema["first"], T.StructField("distance", T.IntegerType())]
    return rows.mapInArrow(scan, T.StructType(fields))


def compared(codes: DataFrame, state: DataFrame, k: int, scratch: Scratch, queries: int = QUERIES) -> DataFrame:
    """(query, code, first, distance): the k nearest codes of each open query, by comparing it with all codes."""
    blocks = -(-state.count() // queries)
    dealt = scratch.write(state.select("query", F.pmod(F.xxhash64("query"), F.lit(2 * blocks)).alias("block")), "outliers")
    parts = []
    for block in range(2 * blocks):
        asked = np.array([r[0] for r in dealt.where(F.col("block") == block).select("query").collect()], np.int64)
        if not len(asked):
            continue
        order = F.row_number().over(W.Window.partitionBy("query").orderBy("distance", "first"))
        parts.append(scratch.write(nearest_of(codes, asked, k).withColumn("n", order).where(F.col("n") <= k).drop("n"), f"outliers-{block}"))
    return reduce(DataFrame.unionAll, parts)


def nearest(vectors: DataFrame, wanted: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """For each row where ``wanted`` holds, its k nearest rows: ``query_id``, ``rank`` from 1, the id and ``distance``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming")
    coded = scratch.write(
        vectors.select(F.col(id_col).alias("id"), code_of(F.col(vector_col), bits).alias("code"), F.coalesce(wanted, F.lit(False)).alias("asks")).where("code is not null"), "coded"
    )
    smallest = F.row_number().over(W.Window.partitionBy("code").orderBy("id"))
    codes = scratch.write(
        coded.where("id is not null").withColumn("n", smallest).where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes"
    )
    total = codes.count()
    m = choose_segments(max(total, 1), k, bits)
    size = widths(m, bits)
    starts = [sum(size[:i]) for i in range(m)]
    parts = lambda code: F.posexplode(F.array(*(_segment(code, a, w) for a, w in zip(starts, size, strict=True)))).alias("seg", "value")
    index = scratch.write(codes.select("code", F.col("ids")[0].alias("first"), parts(F.col("code"))), "index")
    state = scratch.write(coded.where("asks").select(F.col("code").alias("query")).distinct().withColumn("worst", F.lit(bits)), "open-0")
    waiting = state.count()
    top = spark.createDataFrame([], "query long, code long, first long, distance int").withColumn("first", F.col("first").cast(codes.schema["ids"].dataType.elementType))
    for r in range(max(size) + 1):
        # A round that would take more probes a query than there are codes: compare what is still open with all codes.
        if sum(comb(w, r) for w in size) > max(total, 1 << 10):
            top = top.join(state, "query", "left_anti").unionAll(compared(codes, state, k, scratch))
            break
        looking = state.select("query", "worst", parts(F.col("query"))).where(F.col("seg") <= F.col("worst") - m * r)
        probes = probes_of(looking, r, size)
        if waiting * sum(comb(w, r) for w in size) <= SENT_PROBES:
            probes = F.broadcast(probes)
        differ = F.col("query").bitwiseXOR(F.col("code"))
        apart = [F.bit_count(_segment(differ, a, w)) for a, w in zip(starts, size, strict=True)]
        here_first = reduce(lambda a, b: a & b, [(d > r) | ((d == r) & (F.col("at") <= i)) for i, d in enumerate(apart)])
        met = probes.join(
            index, (F.col("at") == F.col("seg")) & (F.col("probe") == F.col("value")) & (F.bit_count(differ) <= F.col("worst")) & here_first
        ).select("query", "code", "first", F.bit_count(differ).alias("distance"))
        order = F.row_number().over(W.Window.partitionBy("query").orderBy("distance", "first"))
        top = scratch.write(top.unionAll(met).withColumn("n", order).where(F.col("n") <= k).drop("n"), f"top-{r}")
        reached = top.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("kth"))
        full = F.coalesce(F.col("found"), F.lit(0)) >= min(k, total)
        left = state.join(reached, "query", "left").where(~(full & (F.col("kth") < m * (r + 1))))
        state = scratch.write(left.select("query", F.when(full, F.col("kth")).otherwise(bits).cast("int").alias("worst")), f"open-{r + 1}")
        waiting = state.count()
        if not waiting:
            break
    rows = top.join(codes, "code").select("query", "distance", F.explode("ids").alias("id"))
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy("distance", "id"))
    answers = scratch.write(rows.withColumn("rank", rank).where(F.col("rank") <= k), "answers")
    asking = coded.where("asks").select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asking.join(answers, "query").select("query_id", "rank", F.col("id").alias(id_col), "distance")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (v.embedding[i] > 0))::INT))::INT AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM pairs
QUALIFY rank <= 10
"""
