"""Near pairs within groups of any size, reduced to forests: their components are those of all near pairs.

A group is dealt into blocks of bounded rows and bytes. A group of one block is compared whole in a task. In a
larger one all blocks first meet the group's pivot, the member of least hash, and what is near it is linked to
it. Members that are not are then compared with every block. Any two members near the pivot are
connected by it, so no pair is passed over; and a group of near copies, however large, costs little more than its rows.

Members may come with the component that is ``known`` of them already: what is known to be connected counts as near, is handed
out as no link again, and isn't compared where it is all that a block holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, partitions, trimmed

#: From members' data, and how many of them are the first side of a two-sided comparison (0: all with all), a forest of near pairs.
Forest = Callable[[list[bytes], int], list[tuple[int, int]]]


def hamming_forest(max_bits: int) -> Forest:
    """Near are codes (of equal length, a multiple of eight bytes) that differ in at most ``max_bits`` bits."""

    def forest(data: list[bytes], first: int) -> list[tuple[int, int]]:
        n = len(data)
        codes = np.frombuffer(b"".join(data), np.uint64).reshape(n, -1)
        step, label = max(1, (1 << 19) // n), np.arange(n)
        rows = first or n
        near = np.empty((rows, n), bool)
        for a in range(0, rows, step):
            part = codes[a : min(a + step, rows)]
            apart = np.zeros((len(part), n), np.uint16)
            for word in range(codes.shape[1]):
                apart += np.bitwise_count(part[:, word, None] ^ codes[None, :, word])
            near[a : a + step] = apart <= max_bits
        if first:
            near[:, :first] = False
        elif near.sum() == n:
            return []
        while True:
            low = label.copy()
            low[:rows] = np.minimum(low[:rows], np.where(near, label[None, :], n).min(axis=1))
            if first:
                low = np.minimum(low, np.where(near, label[:rows, None], n).min(axis=0))
            low = low[low]
            if (low == label).all():
                return [(int(k), i) for i, k in enumerate(label) if i != k]
            label = low

    return forest


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``; two empty ones are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def jaccard_forest(least: float) -> Forest:
    """Near are sorted sets of 64-bit hashes of at least that similarity. Pairs that are connected already aren't compared."""

    def forest(data: list[bytes], first: int) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in data]
        label, members, out = list(range(len(sets))), {i: [i] for i in range(len(sets))}, []
        for i in range(first or 1, len(sets)):
            for j in range(first or i):
                if label[i] == label[j] or not similar(sets[i], sets[j], least):
                    continue
                out.append((j, i))
                gone, kept = sorted((label[i], label[j]), key=lambda x: len(members[x]))
                for x in members[gone]:
                    label[x] = kept
                members[kept] += members.pop(gone)
        return out

    return forest


def fresh(found: list[tuple[int, int]], known: list) -> list[tuple[int, int]]:
    """Those of the links found that connect what isn't connected yet, by what is known and by links before them."""
    parent: dict = {}

    def top(x: object) -> object:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in found:
        a, b = top(known[i]), top(known[j])
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list, int]]:
    """(group, nodes, data, what is known of each, members of the first side) of each run of rows with one ``cell``, over batches."""
    cell, group, nodes, data, known, first = None, 0, [], [], [], 0
    for batch in batches:
        at = batch.column("cell").to_numpy()
        bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if at[a] != cell:
                if len(nodes) > 1:
                    yield group, nodes, data, known, first
                cell, group, nodes, data, known, first = at[a], batch.column("grp")[a].as_py(), [], [], [], 0
            part = batch.slice(a, b - a)
            nodes += part.column("node").to_pylist()
            data += part.column("data").to_pylist()
            known += part.column("known").to_pylist()
            first += part.num_rows - int(part.column("side").to_numpy().sum())
    if len(nodes) > 1:
        yield group, nodes, data, known, first


def _compared(cells: DataFrame, forest: Forest, two_sided: bool) -> DataFrame:
    """(grp, a, b, near) from rows (cell, side, grp, node, data, known). In two-sided cells of one pivot, those not near it come too, with ``near`` false."""
    kind = cells.schema["node"].dataType

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        type_of = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), type_of, type_of, pa.bool_()), strict=True)], names=["grp", "a", "b", "near"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal type_of
            for batch in batches:
                type_of = batch.schema.field("node").type
                yield batch

        for group, nodes, data, known, first in _cells(typed()):
            if all(k == known[0] for k in known):
                continue
            found = forest(data, first if two_sided else 0)
            held += [(group, nodes[i], nodes[j], True) for i, j in fresh(found, known)]
            if two_sided and first == 1:
                near = {j for _, j in found} | {j for j, k in enumerate(known) if k == known[0]}
                held += [(group, nodes[0], nodes[j], False) for j in range(1, len(nodes)) if j not in near and nodes[j] != nodes[0]]
            if len(held) >= 8192:
                yield out()
                held = []
        if held:
            yield out()

    schema = cells.select("grp").schema.add("a", kind).add("b", kind).add("near", "boolean")
    dealt = cells.repartition(partitions(cells.sparkSession), "cell").sortWithinPartitions("cell", "side")
    return dealt.select("cell", "side", "grp", "node", "data", "known").mapInArrow(trimmed(compare), schema)


def group_links(members: DataFrame, scratch: Scratch, label: str, forest: Forest, block_rows: int = 1024, block_bytes: int = 1 << 23) -> DataFrame:
    """Edges (a, b) whose components are those of all near pairs of one group; ``members`` has ``grp`` (long), ``node``, ``data``.

    It may have ``known``, of the node's type: nodes that have it in common are connected already, and links between them may be left out.
    """
    if "known" not in members.columns:
        members = members.withColumn("known", F.col("node"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("bytes") / block_bytes)).cast("int")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes"))
    large = scratch.write(sizes.where("n > 1").select("grp", blocks.alias("blocks")).where("blocks > 1"), f"{label}-large")
    crowded = not large.isEmpty()
    alone = members.join(large, "grp", "left_anti") if crowded else members
    one_side = _compared(alone.select(F.col("grp").alias("cell"), F.lit(0).alias("side"), "grp", "node", "data", "known"), forest, False)
    edges = scratch.write(one_side.select("a", "b"), f"{label}-small")
    if not crowded:
        return edges
    dealt = scratch.write(members.join(large, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), f"{label}-dealt")
    pivots = dealt.groupBy("grp", "blocks").agg(F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node", "data", "known")).alias("p"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = dealt.select("grp", "block", F.lit(1).alias("side"), "node", "data", "known").unionAll(
        pivots.select("grp", every("blocks").alias("block"), F.lit(0).alias("side"), "p.node", "p.data", "p.known")
    )
    pivoted = scratch.write(_compared(met.withColumn("cell", F.xxhash64("grp", "block")), forest, True), f"{label}-pivoted")
    far = pivoted.where("not near").select("grp", F.col("b").alias("node"))
    rest = scratch.write(dealt.join(far, ["grp", "node"], "left_semi").select("grp", "blocks", "node", "data", "known"), f"{label}-rest")
    shares = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes")).select("grp", F.greatest(blocks, F.lit(1)).alias("shares"))
    left = rest.join(shares, "grp").select("grp", every("blocks").alias("block"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("shares")).cast("int").alias("share"), F.lit(0).alias("side"), "node", "data", "known")
    right = dealt.join(shares, "grp").select("grp", "block", every("shares").alias("share"), F.lit(1).alias("side"), "node", "data", "known")
    crossed = _compared(left.unionAll(right).withColumn("cell", F.xxhash64("grp", "block", "share")), forest, True)
    return edges.unionAll(pivoted.where("near").select("a", "b")).unionAll(scratch.write(crossed.where("near").select("a", "b"), f"{label}-crossed"))
