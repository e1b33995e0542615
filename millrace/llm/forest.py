"""Operator 13, approximate nearest neighbours: a hash-prefix forest (LSH forest) by largest inner product.

Each of ``TREES`` trees gives a vector a string of ``LETTERS`` letters. A letter is the largest of ``DIRECTIONS`` random
orthogonal projections and its sign, so near vectors share longer prefixes. A tree is a sorted array of strings: all
vectors with a prefix stand together in it. A query descends each tree to its longest match, then ascends all trees
at once, letter by letter, until the vectors under its prefixes, summed over the trees, are more than a share of the rows; these
are its candidates, and are scored exactly in double precision. With no letter left, all rows are candidates.

The largest inner product is the smallest angle once a component is added that brings all vectors to one norm, and to
queries a zero; strings are made of such vectors.

How large the share must be depends on the data and the number of rows. It is measured, not guessed: ``SAMPLE`` queries are
compared with all rows, and each of their true neighbours tells with which share it would be found; the share is that which finds
``GOAL`` of them. The sample is the only bounded thing; all rows are indexed.

Rows stay where they are read: a task builds the trees of its rows, ``BLOCK_ROWS`` at a time, and asks them about the queries,
which are sent to all tasks in blocks of ``QUERIES``; it keeps the k best of each query and yields them once. So what
is shuffled is k rows a query and task, whatever the number of candidates, and memory is bounded by block sizes. The
price is that every query meets every block, as the stated set of queries grows with the rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; of vectors with different
numbers of components those of the most frequent number do (ties: the smaller). Rows without id are neither found nor asked. Rows with
the query's own id aren't found by it. Ids are integers (cast to long). Repeated rows are found as often as they stand, ties go to the smaller id; repeated
queries are answered once, and different vectors of one id have a list each. With k candidates or fewer all are found. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import Scratch

TREES, LETTERS, DIRECTIONS, SEED = 32, 4, 32, 13
SAMPLE, GOAL = 64, 0.96
QUERIES, BLOCK_ROWS = 1 << 14, 1 << 15


def projections(dims: int) -> np.ndarray:
    """letters of all trees x dims x directions: orthonormal directions, as many as there can be; always the same ones."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :DIRECTIONS] for _ in range(TREES * LETTERS)]).astype(np.float32)


def strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """trees x rows: each tree's letters as one number, the first letter in front."""
    out = np.zeros((TREES, len(unit)), np.uint32)
    rows = np.arange(len(unit))
    for k in range(TREES * LETTERS):
        along = unit @ planes[k]
        most = np.abs(along).argmax(axis=1)
        out[k // LETTERS] = out[k // LETTERS] * np.uint32(2 * planes.shape[2]) + (2 * most + (along[rows, most] > 0)).astype(np.uint32)
    return out


def raised(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows brought to one norm by another component."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return (np.column_stack([x, rest]) / norm).astype(np.float32)


def asked(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))]).astype(np.float32)


class Forest:
    """The trees over a block of rows."""

    def __init__(self, x: np.ndarray, norm: float, planes: np.ndarray):
        of = strings(raised(x, norm), planes)
        self.x, self.letters, self.size = x, 2 * planes.shape[2], len(x)
        self.order = of.argsort(axis=1, kind="stable")
        self.sorted = np.take_along_axis(of, self.order, axis=1)

    def ranges(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """trees x queries: where the rows that share a prefix of ``depth`` letters begin and end in each sorted array."""
        span = np.uint32(self.letters ** (LETTERS - depth))
        low = queries // span * span
        ends = [(np.searchsorted(s, q, "left"), np.searchsorted(s, q + (span - np.uint32(1)), "right")) for s, q in zip(self.sorted, low, strict=True)]
        return np.stack([e[0] for e in ends]), np.stack([e[1] for e in ends])

    def ascend(self, queries: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, starts, ends) of those that end their ascent at each depth; at the last, the root, there are no ranges but all rows."""
        left = np.arange(queries.shape[1])
        for depth in range(LETTERS, 0, -1):
            start, end = self.ranges(queries[:, left], depth)
            enough = (end - start).sum(axis=0) > share * self.size * (1 + 1e-9)
            yield left[enough], start[:, enough], end[:, enough]
            left = left[~enough]
            if not len(left):
                return
        yield left, np.empty((0, len(left)), np.int64), np.empty((0, len(left)), np.int64)

    def candidates(self, queries: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows) for every query."""
        for some, start, end in self.ascend(queries, share):
            for n, query in enumerate(some.tolist()):
                if not len(start):
                    yield query, np.arange(self.size)
                    continue
                near = np.zeros(self.size, bool)
                for order, a, b in zip(self.order, start[:, n].tolist(), end[:, n].tolist(), strict=True):
                    near[order[a:b]] = True
                yield query, np.flatnonzero(near)

    def needs(self, queries: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and row, the least share with which the row is a candidate."""
        counts = np.zeros((LETTERS + 1, queries.shape[1]))
        matched = [np.zeros(len(r), np.int64) for r in rows]
        place = np.empty_like(self.order)
        np.put_along_axis(place, self.order, np.arange(self.size)[None, :], axis=1)
        for depth in range(1, LETTERS + 1):
            start, end = self.ranges(queries, depth)
            counts[depth - 1] = (end - start).sum(axis=0) / self.size
            for q, r in enumerate(rows):
                there = (place[:, r] >= start[:, q, None]) & (place[:, r] < end[:, q, None])
                matched[q][there.any(axis=0)] = depth
        return [counts[m, q] for q, m in enumerate(matched)]


def scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up alike for every row, so that equal vectors have equal scores."""
    return (x * query).sum(axis=1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest score, ties to the smaller id, best first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most so many rows each, over batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            if count + part.num_rows > most:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, count = [], 0
            held.append((part.column("id").to_numpy(), _vectors(part.column("vector"))))
            count += part.num_rows
    if count:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


class Queries:
    """A block of queries as broadcast: their numbers, ids, vectors and strings."""

    def __init__(self, rows: list, planes: np.ndarray):
        self.number = np.array([r["query"] for r in rows], np.int64)
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.x = np.array([r["vector"] for r in rows], np.float64)
        self.strings = strings(asked(self.x), planes)


def _found(rows: DataFrame, queries: Queries, planes: np.ndarray, norm: float, k: int, share: float | None, block_rows: int) -> DataFrame:
    """(query, id, score, need): each task's k best rows of each query; with a share among its candidates, without one of all rows, and the shares that they need."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, planes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, planes = shared.value
        top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0), np.empty(0))] * len(queries.ids)
        for ids, x in _blocks(batches, block_rows):
            forest = Forest(x, norm, planes)
            chosen: list = [None] * len(queries.ids)
            for q, near in forest.candidates(queries.strings, share) if share is not None else ((q, np.arange(len(x))) for q in range(len(chosen))):
                near = near[ids[near] != queries.ids[q]]
                score = scores(x[near], queries.x[q])
                some = best(score, ids[near], k)
                chosen[q] = near[some], score[some]
            needs = forest.needs(queries.strings, [c[0] for c in chosen]) if share is None else [np.zeros(len(c[0])) for c in chosen]
            for q, (near, score) in enumerate(chosen):
                both = [np.concatenate(c) for c in zip(top[q], (ids[near], score, needs[q]), strict=True)]
                some = best(both[1], both[0], k)
                top[q] = tuple(c[some] for c in both)
        sizes = [len(t[0]) for t in top]
        ids, score, need = (np.concatenate(c) for c in zip(*top, strict=True))
        for a in range(0, len(ids), 1 << 16):
            cut = slice(a, a + (1 << 16))
            columns = [np.repeat(queries.number, sizes)[cut], ids[cut], score[cut], need[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "score", "need"])

    found = rows.select("id", "vector").mapInArrow(search, "query long, id long, score double, need double")
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, wanted: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", goal: float = GOAL, share: float | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each row where ``wanted`` holds, k rows of largest inner product: ``query_id``, ``rank`` from 1, the id and ``score``.

    A ``share`` that is given isn't measured; above TREES it makes all rows candidates.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    value = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(wanted, F.lit(False)).alias("asks")).where("id is not null")
    square = F.aggregate(value, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0))
    shape = rows.groupBy(F.size(value).alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm")).orderBy(F.desc("n"), "dims").limit(1).collect()
    schema = rows.select("id").schema.add("rank", "integer").add("other", "long").add("score", "double")
    if not shape:
        return spark.createDataFrame([], schema).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")
    dims, norm = shape[0]["dims"], shape[0]["norm"]
    rows = rows.where(F.size(value) == dims)
    planes = projections(dims + 1)
    # The queries under numbers of their own: a query is a vector of an id.
    numbered = scratch.write(rows.where("asks").select("id", "vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = -(-numbered.count() // QUERIES)
    sample = numbered.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], schema).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")
    if share is None:
        needs = [r["need"] for r in _found(rows, Queries(sample, planes), planes, norm, k, None, block_rows).select("need").collect()]
        share = float(np.quantile(needs, goal, method="higher")) if needs else 0.0
    dealt = scratch.write(numbered.withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(2 * blocks))), "dealt")
    parts = []
    for block in range(2 * blocks):
        some = dealt.where(F.col("block") == block).collect()
        if some:
            parts.append(scratch.write(_found(rows, Queries(some, planes), planes, norm, k, share, block_rows).select("query", "rank", "id", "score"), f"found-{block}"))
    names = dealt.select("query", F.col("id").alias("query_id"))
    return reduce(DataFrame.unionAll, parts).join(names, "query").select("query_id", "rank", F.col("id").alias(id_col), "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows found of every vector whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
