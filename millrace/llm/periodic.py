"""Operator 11, periodic runs of words: branching tandem repeats from an enhanced suffix array, rotated and merged.

A run is a stretch of consecutive words with smallest period q, at least ``2 * q`` and ``min_words`` long, that no
neighbouring word extends keeping that period. Every run ends in exactly one square whose root is no power of
another word and that isn't followed by the same square one word later: a branching tandem repeat.

The texts of a block are sorted together, by words that are numbered for each text, so that no two texts share a prefix:
prefix doubling sorts suffixes that are still alike only, and its ranks by 1, 2, 4, ... words give the longest common
prefixes (LCP). A pass with a stack lists the LCP intervals as three numbers each; no tree is built. In an
interval of depth d each suffix i of a child, but for the largest child's, asks the inverse suffix array whether
i + d or i - d is in the interval, too, and in another child: then a square of period d branches there. As suffixes are asked
in smaller children only, each is asked at most log n times. Squares are rotated to the left while words agree, which
gives the run; roots that are powers are the same run with a larger period, and are left out.

A text is worked on by one task, with some hundred bytes a word and four more for each doubling that its longest
repeated passage takes; texts are read in blocks of bounded size, a longer text alone.

Defined cases: null, empty and blank texts have no run and collapse to the empty text. Null and repeated ids, and
repeated rows, are answered row by row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import slices

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 12
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
#: Bytes of text that are sorted together, and suffixes that are asked about at a time.
BLOCK_BYTES, ASKED = 1 << 20, 1 << 21


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of all suffixes, its inverse, and the LCP of each suffix with the one before it in order.

    ``ends`` is where each position's text ends; texts have no code in common.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.ones(n, bool)
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # The doubling that tells each suffix from the one before it.
    apart = np.where(first, 0, -1)
    levels: list[np.ndarray] = []
    alike = ~first
    alike[:-1] |= ~first[1:]
    slots = np.flatnonzero(alike)
    while len(slots):
        levels.append(rank.astype(np.int32))
        own = order[slots]
        after = own + (1 << len(levels) - 1)
        key = rank[own] * (n + 1) + np.where(after < ends[own], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        apart[slots[new & (apart[slots] < 0)]] = len(levels)
        alike = ~new
        alike[:-1] |= ~new[1:]
        slots = slots[alike]
    lcp = np.zeros(n, np.int64)
    for k in reversed(range(len(levels))):
        # Told apart by the (k+1)-th doubling or later: alike in 2**k words, or known to be longer alike already.
        pairs = np.flatnonzero(apart > k)
        a, b = order[pairs - 1], order[pairs]
        at_a, at_b = a + lcp[pairs], b + lcp[pairs]
        inside = (at_a < ends[a]) & (at_b < ends[b])
        same = inside & (levels[k][np.minimum(at_a, n - 1)] == levels[k][np.minimum(at_b, n - 1)])
        lcp[pairs[same]] += 1 << k
    return order, rank, lcp


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, left and right end of each interval, and for each place of the order the interval that is split before it (-1: none)."""
    depth, left, right, owner = [], [], [], []
    depths, lefts, names = [0], [0], [-1]
    for k, v in enumerate([*lcp.tolist()[1:], 0]):
        start = k
        while depths[-1] > v:
            depths.pop()
            start = lefts.pop()
            right[names.pop()] = k
        if depths[-1] < v:
            depths.append(v)
            lefts.append(start)
            names.append(len(depth))
            depth.append(v)
            left.append(start)
            right.append(0)
        owner.append(names[-1])
    return np.array(depth, np.int64), np.array(left, np.int64), np.array(right, np.int64), np.array([-1, *owner[:-1]], np.int64)


def smaller_children(left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (not included) and interval of every child but the largest of its interval."""
    splits = np.flatnonzero(owner >= 0)
    start, of = np.concatenate([left, splits]), np.concatenate([np.arange(len(left)), owner[splits]])
    by = np.lexsort((start, of))
    start, of = start[by], of[by]
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    end = np.where(last, right[of] + 1, np.append(start[1:], 0))
    by = np.lexsort((start - end, of))
    start, end, of = start[by], end[by], of[by]
    small = np.zeros(len(of), bool)
    small[1:] = of[1:] == of[:-1]
    return start[small], end[small], of[small]


def branching_squares(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every branching tandem repeat; those with a power as root are among them. Each once, by end and period."""
    order, inverse, lcp = suffix_array(codes, ends)
    depth, left, right, owner = lcp_intervals(lcp)
    child_start, child_end, of = smaller_children(left, right, owner)
    found = [np.empty((0, 2), np.int64)]
    sizes = np.cumsum(child_end - child_start)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + ASKED, "right")))
        size = child_end[a:b] - child_start[a:b]
        child = np.repeat(np.arange(a, b), size)
        slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + child_start[child]
        i, d = order[slot], depth[of[child]]
        lo, hi = left[of[child]], right[of[child]]
        for other, square in ((i + d, i), (i - d, i - d)):
            inside = (other < ends[i]) & (other >= starts[i])
            there = inverse[np.where(inside, other, 0)]
            hit = inside & (there >= lo) & (there <= hi) & ((there < child_start[child]) | (there >= child_end[child]))
            found.append(np.stack([square[hit], d[hit]], axis=1))
        a = b
    squares = np.unique(np.concatenate(found), axis=0)
    place, period = squares[:, 0], squares[:, 1]
    by = np.lexsort((period, place + 2 * period))
    return place[by], period[by]


def leftmost(codes: np.ndarray, place: int, period: int, floor: int) -> int:
    """Rotate a square to the left while the word before it agrees with the word a period later; where that ends."""
    step = 64
    while place > floor:
        a = max(floor, place - step)
        differ = np.flatnonzero(codes[a:place] != codes[a + period : place + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        place, step = a, step * 4
    return floor


def runs_of(words: list[list[bytes]], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """For each text's words, its runs as (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return out
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for text in words for w in text), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(words)), sizes)
    codes = code + text_of * len(known)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends = bounds[text_of], bounds[text_of + 1]
    place, period = branching_squares(codes, starts, ends)
    # Short squares that can't be rotated far enough to make a run.
    long = np.ones(len(place), bool)
    for k in range(1, min_words - 1):
        asked = np.flatnonzero(long & (2 * period + k <= min_words))
        i, p = place[asked] - k, period[asked]
        long[asked] = (i >= starts[place[asked]]) & (codes[i] == codes[i + p])
    at, longest = -1, 0
    for i, p in zip(place[long].tolist(), period[long].tolist(), strict=True):
        end = i + 2 * p
        if end == at and 2 * p <= longest:
            continue  # its root is a power: the run has been found with a smaller period
        floor = int(starts[i])
        start = leftmost(codes, i, p, floor)
        longest = end - start if end != at else max(longest, end - start)
        at = end
        out[text_of[i]].append((start - floor, end - start, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run its first period stays, unless another run repeats that."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words if kept.all() else [words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: its id, ``runs`` (start, length, period; by start and period) and ``collapsed``, its words without what runs repeat."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BLOCK_BYTES):
            words = [(x.as_py() or b"").split() for x in part.column(1)]  # bytes.split knows exactly the white space meant here
            runs = runs_of(words, min_words)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            left = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind), pa.array(left, pa.binary())], names=[id_col, "runs", "collapsed"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    schema = rows.select(id_col).schema.add("runs", RUNS).add("collapsed", "binary")
    return rows.mapInArrow(detect, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text, with a tail of its words made periodic in every tenth document by the hash of its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    return F.when(
        (h % 10 == 0) & (n > 0),
        F.array_join(
            F.transform(
                F.array(F.struct(words.alias("w"), (g % n).cast("int").alias("a"), (F.floor((n - g % n) / (3 + g % 8)) + 1).cast("int").alias("p"))),
                lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " "),
            ),
            " ",
        ),
    ).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, some of them with a planted one: how many, the greatest, and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs(docs).withColumn("top", greatest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / (-F.col("top.period"))).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
