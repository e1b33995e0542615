"""Operator 8, SimHash near-duplicates: fingerprints linked by the general pigeonhole principle.

A text's fingerprint is the 64-bit majority of the XXH64 values of its word shingles. Two
fingerprints that differ in at most ``max_bits`` bits are linked. To find the links, bits that are correlated
over all fingerprints are grouped into m partitions, and partition i gets a threshold t_i, where
the thresholds sum to ``max_bits`` - m + 1: then linked fingerprints differ by at most t_i in some partition i
(t_i = -1: the partition isn't probed). Dynamic programming chooses the thresholds that
give the fewest candidates, estimated from the exact counts of each partition's values.

Probing is by equal keys: a key keeps a partition's bits but for a choice of t_i of them, and two
values within t_i share one. A bucket of fingerprints under one key is verified whole if it has at most
``bucket_rows``; larger ones are probed by centres instead: each fingerprint goes to every value
within half of ``max_bits`` of it, and linked ones meet at some value, where at most a ball's
worth of fingerprints can be. Either way a bucket gives a forest, not its pairs. Only distinct fingerprints take
part; connected components of the forests are the groups.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; copies
and repeated rows share a component. A null id never names a component, unless all its ids are null.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.linking import group_links, hamming_forest, jaccard_forest
from millrace.llm.shared import Scratch, longs, maybe_among, slices, trimmed

BITS = 64
#: What a comparison of two fingerprints costs, in rows of keys.
PAIR_COST = 0.002
FULL = (1 << BITS) - 1
SEED = 42
#: The pipeline's stage: the least Jaccard similarity of near copies' shingles of so many words.
STAGE_SIMILARITY = 0.8
STAGE_SHINGLE = 5
#: Fingerprints a text, at least and at most; the bits that any of them may differ in to be found for certain; the share of all
#: their bits that may differ in a candidate.
STAGE_SEEDS, MOST_SEEDS, STAGE_BITS, FAR = 6, 24, 4, 7 / 32
#: The share of pairs of just that similarity that probing has to find, by calculation, and what a fingerprint costs, in rows of keys.
STAGE_RECALL, SEED_COST = 0.95, 2
#: Candidates that are compared as one block.
BLOCK_ROWS = 1024


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """bytes.lower and bytes.split know exactly the letters A-Z and the white space meant here."""
    words = text.lower().split() if text else []
    k = min(shingle, len(words))
    value = xxhash.xxh64_intdigest
    return np.fromiter((value(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)), strict=False)), np.uint64)


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each column of hashes, the bits that are set in over half of its rows.

    Bits become bytes, eight of which are added at once as one number: 255 rows can't overflow a byte.
    """
    rows, columns = hashes.shape
    ones = np.zeros(columns * BITS, np.int64)
    for at in range(0, rows, 255):
        part = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8), bitorder="little").reshape(-1, columns * BITS)
        ones += part.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(ones * 2 > rows, bitorder="little").view(np.uint64)


def majority(hashes: np.ndarray) -> int:
    return int(majorities(hashes[:, None])[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def reseeded(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes that a k-th seed might have given: SplitMix64's finisher over a shifted state; 0 leaves them as they are."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & FULL)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp), the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(trimmed(make), rows.select(id_col).schema.add("fp", "long"))


def co_occurrence(distinct: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints: summed in the tasks, then over them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8)
            bits = np.unpackbits(values, bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.indices(total.shape, np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS), np.int64)
    for i, j, n in distinct.select("fp").mapInArrow(trimmed(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return out


def correlated_groups(both: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Deal the bits into partitions of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    deviation = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    rho = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(rho, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda b: rho[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: rho[b, group].mean())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocations(widths: list[int], rows: int, pairs: list[int], crowded: list[list[int]], max_bits: int) -> dict[int, tuple[float, list[int]]]:
    """For each sum of thresholds the least cost and the thresholds that have it, by dynamic programming.

    ``pairs`` counts, for each partition, the pairs of different fingerprints with one value. A threshold t makes
    C(width, t) keys a row, and dropping t bits makes as many as 2**t times the pairs under each.
    ``crowded[i][t]`` is how many fingerprints are in buckets too large to be verified whole then: they go to centres.
    """
    centres = _ball(-(-max_bits // 2))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, found, over in zip(widths, pairs, crowded, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, max_bits + 1):
                more = 0 if t < 0 else comb(width, t) * (rows + PAIR_COST * found * 2**t) + centres * over[t]
                if total + t not in step or cost + more < step[total + t][0]:
                    step[total + t] = (cost + more, [*chosen, t])
        best = step
    return best


def allocate(widths: list[int], rows: int, pairs: list[int], crowded: list[list[int]], max_bits: int) -> tuple[float, list[int]]:
    """The least cost and its thresholds, with the sum that the principle asks for."""
    return allocations(widths, rows, pairs, crowded, max_bits)[max_bits - len(widths) + 1]


def near_rate(similarity: float) -> float:
    """The share of bits that differ between fingerprints of texts of such a Jaccard similarity.

    A bit is the sign of a sum over shingles. The sums of texts that share a part of their shingles are correlated by
    that part, and differ in sign with the angle whose cosine that is.
    """
    return acos(2 * similarity / (1 + similarity)) / pi


def found_share(widths: list[int], thresholds: list[int], rate: float) -> float:
    """How many pairs share a probe key of one fingerprint if each bit differs with that probability."""
    missed = 1.0
    for width, t in zip(widths, thresholds, strict=True):
        missed *= 1 - sum(comb(width, r) * rate**r * (1 - rate) ** (width - r) for r in range(t + 1))
    return 1 - missed


def seeds_for(widths: list[int], thresholds: list[int], rate: float, goal: float) -> int:
    """Fingerprints a text that find the goal's share of pairs."""
    found = found_share(widths, thresholds, rate)
    return 1 if found >= goal else ceil(log(1 - goal) / log(1 - found)) if found > 0 else FULL


def _ball(radius: int) -> int:
    return sum(comb(BITS, r) for r in range(radius + 1))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks_of(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """The masks of all keys: a partition's bits without each choice of as many bits as its threshold."""
    return [sum(1 << b for b in group if b not in gone) for group, t in zip(groups, thresholds, strict=True) if t >= 0 for gone in combinations(group, t)]


def keys_of(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, value, fp): one row for each fingerprint and mask."""
    return rows.select("fp", F.explode(longs([signed(m) for m in masks])).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp"
    )


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a bucket reduced to (member, smallest member that it reaches), a few rows of the comparison at a time."""
    label = np.arange(len(values))
    step = max(1, (1 << 20) // len(values))
    while True:
        low = label.copy()
        for a in range(0, len(values), step):
            near = np.bitwise_count(values[a : a + step, None] ^ values[None, :]) <= max_bits
            low[a : a + step] = np.where(near, low[None, :], len(values)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return [(int(values[i]), int(values[k])) for i, k in enumerate(label) if i != k]
        label = low


def verified(buckets: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) from rows that each hold a bounded list ``fps``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0) for e in _forest(np.array(fps.as_py(), np.int64).view(np.uint64), max_bits)]
            ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return buckets.select("fps").mapInArrow(trimmed(verify), "a long, b long")


def layouts(distinct: DataFrame, max_bits: int, bucket_rows: int) -> list[tuple[list[list[int]], tuple]]:
    """Groupings of the bits into partitions, each with what ``allocations`` asks for, from counts over all fingerprints."""
    rows, both = distinct.count(), co_occurrence(distinct)
    groupings = [correlated_groups(both, rows, m) for m in range(2, min(max_bits + 1, 6) + 1)] or [[list(range(BITS))]]
    whole = [[sum(1 << b for b in g) for g in groups] for groups in groupings]
    counted = keys_of(distinct, sorted({m for masks in whole for m in masks})).groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
    over = [F.sum(F.when(F.col("n") * 2**t > bucket_rows, F.col("n")).otherwise(0)) for t in range(max_bits + 1)]
    sums = {r[0]: r for r in counted.groupBy("mask").agg(F.sum(F.expr("cast(n as decimal(38,0)) * (n - 1)")), F.array(*over)).collect()}
    out = []
    for groups, masks in zip(groupings, whole, strict=True):
        known = [sums.get(signed(m), (0, 0, [0] * (max_bits + 1))) for m in masks]
        out.append((groups, ([len(g) for g in groups], rows, [int(k[1]) for k in known], [k[2] for k in known], max_bits)))
    return out


def choose_keys(distinct: DataFrame, max_bits: int, bucket_rows: int) -> list[int]:
    """Masks of the keys of the cheapest choice of partitions and thresholds."""
    found = [(*allocate(*counts), groups) for groups, counts in layouts(distinct, max_bits, bucket_rows)]
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return masks_of(groups, thresholds)


def choose_probes(distinct: DataFrame, max_bits: int, bucket_rows: int, similarity: float) -> tuple[list[int], int]:
    """Masks of keys and fingerprints a text, the cheapest that find STAGE_RECALL of pairs of that similarity, and all within ``max_bits`` bits.

    Larger tables get wider keys, which find fewer pairs by one fingerprint: so they get more fingerprints, and the recall stays.
    """
    rate, found = near_rate(similarity), []
    for groups, counts in layouts(distinct, max_bits, bucket_rows):
        widths, rows = counts[:2]
        for total, (cost, thresholds) in allocations(*counts).items():
            seeds = max(STAGE_SEEDS, seeds_for(widths, thresholds, rate, STAGE_RECALL))
            if total >= max_bits - len(widths) + 1 and seeds <= MOST_SEEDS:
                found.append((seeds * (cost + SEED_COST * rows), seeds, thresholds, groups))
    _, seeds, thresholds, groups = min(found, key=lambda x: x[:3])
    return masks_of(groups, thresholds), seeds


def links(distinct: DataFrame, scratch: Scratch, max_bits: int = 2, bucket_rows: int = 2048) -> DataFrame:
    """Edges whose components are those of all links between the distinct fingerprints in column ``fp``."""
    keys = keys_of(distinct, choose_keys(distinct, max_bits, bucket_rows))
    shared = scratch.write(keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_keys")
    members = keys.join(shared, ["mask", "value"])
    small = members.where(F.col("n") <= bucket_rows).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
    # Too many under one key: meet at centres. Each centre has at most the fingerprints of the ball round it.
    flips = [sum(1 << b for b in c) for r in range(-(-max_bits // 2) + 1) for c in combinations(range(BITS), r)]
    centres = members.where(F.col("n") > bucket_rows).select("fp").distinct().select("fp", F.explode(longs([signed(x) for x in flips])).alias("flip"))
    large = centres.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return verified(small, max_bits).unionAll(verified(large, max_bits))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, bucket_rows: int = 2048
) -> DataFrame:
    """One row a document: its id, ``fingerprint`` in hex and ``component_id``, the smallest id that it reaches."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = scratch.write(found.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), scratch, max_bits, bucket_rows), scratch)
    roots = scratch.write(roots.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "first"), "roots")
    names = roots.groupBy("root").agg(F.min("first").alias("name"))
    named = roots.join(names, "root").select("node", "name")
    classes = scratch.write(
        distinct.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("name", "first").alias("component_id")), "classes"
    )
    return found.join(classes, F.col("fp") == F.col("of")).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def prints_of(docs: DataFrame, seeds: int) -> DataFrame:
    """(id, digest, fps): a fingerprint for each seed, and a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), 3)
                found.append(majorities(np.stack([reseeded(hashes, k) for k in range(seeds)], axis=1)))
            flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * seeds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), fps], names=["id", "digest", "fps"])

    rows = docs.select(F.col("doc_id").alias("id"), digest_of("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(make), rows.select("id", "digest").schema.add("fps", T.ArrayType(T.LongType())))


def candidates(codes: DataFrame, scratch: Scratch, masks: list[int], seeds: int) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints share a probe key by one seed and agree over all seeds.

    ``codes`` has ``node`` and ``fps``. What shares a key is compared over the fingerprints of all seeds, of which at
    most FAR of the bits may differ.
    """
    data = F.unhex(F.array_join(F.transform("fps", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    near = hamming_forest(int(seeds * BITS * FAR))

    def linked(rows: DataFrame, some: Column, label: str) -> DataFrame:
        probes = rows.select("node", "known", data.alias("data"), F.posexplode("fps").alias("seed", "fp")).where(some)
        probes = probes.select("node", "known", "data", "seed", "fp", F.posexplode(longs([signed(m) for m in masks])).alias("at", "mask"))
        keyed = probes.select(F.xxhash64("seed", "at", F.col("fp").bitwiseAND(F.col("mask"))).alias("grp"), "node", "data", "known")
        return group_links(keyed, scratch, label, near, BLOCK_ROWS)

    # What the first fingerprint connects needs no links by the others: near copies would get one by each of their keys.
    first = linked(codes.withColumn("known", F.col("node")), F.col("seed") == 0, "codes-first")
    roots = components(first, scratch, "first_components").withColumnRenamed("node", "of")
    known = codes.join(roots, F.col("node") == F.col("of"), "left").select("node", "fps", F.coalesce("root", "node").alias("known"))
    return first.unionAll(linked(scratch.write(known, "known_codes"), F.col("seed") > 0, "codes-rest"))


def similar_texts(clusters: DataFrame, texts: DataFrame, scratch: Scratch, least: float, block_rows: int = 1024, block_bytes: int = 1 << 23) -> DataFrame:
    """Edges (a, b) whose components are those of all similar pairs of one cluster, told from their whole shingle sets."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(x.as_py(), STAGE_SHINGLE)).tobytes() for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("node"), pa.array(sets, pa.binary())], names=["grp", "node", "data"])

    rows = texts.join(clusters, "digest").select(F.xxhash64("cluster").alias("grp"), F.col("digest").alias("node"), "text")
    sets = scratch.write(rows.mapInArrow(trimmed(shingled), "grp long, node string, data binary"), "shingles")
    return group_links(sets, scratch, "texts", jaccard_forest(least), block_rows, block_bytes)


def near_copies(docs: DataFrame, scratch: Scratch, max_bits: int, least: float) -> DataFrame:
    """(digest, id, name) of each text and id: ``name`` is the smallest id of the texts that similar pairs connect it with."""

    def printed(seeds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        prints = scratch.write(prints_of(docs, seeds), f"prints-{seeds}")
        firsts = prints.groupBy("digest").agg(F.min("id").alias("first"), F.first("fps").alias("fps")).withColumn("node", F.xxhash64("fps"))
        firsts = scratch.write(firsts, f"firsts-{seeds}")
        return prints, firsts, scratch.write(firsts.groupBy("node").agg(F.first("fps").alias("fps"), F.count(F.lit(1)).alias("texts")), f"codes-{seeds}")

    prints, firsts, codes = printed(STAGE_SEEDS)
    masks, seeds = choose_probes(codes.select(F.col("fps")[0].alias("fp")).distinct(), max_bits, BLOCK_ROWS, least)
    if seeds > STAGE_SEEDS:
        prints, firsts, codes = printed(seeds)
    edges = candidates(codes.select("node", "fps"), scratch, masks, seeds)
    roots = components(edges, scratch, "code_components")
    # Texts of a cluster: those that links connect, and those that have all fingerprints in common.
    joined = codes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    clustered = joined.where("root is not null or texts > 1").select("node", F.coalesce("root", "node").alias("cluster"))
    clusters = scratch.write(firsts.join(clustered, "node").select("digest", "first", "cluster"), "clusters")
    marked = maybe_among(docs.withColumn("__digest", digest_of("text")), "__digest", clusters.select(F.col("digest").alias("id")), scratch, "clustered").where("__maybe")
    named = marked.select(F.col("doc_id").alias("__id"), F.col("__digest").alias("digest"), F.col("text").cast("binary").alias("text"))
    # One row a text, that of its smallest id.
    wanted = named.join(clusters.select(F.col("digest").alias("of"), "first"), (F.col("digest") == F.col("of")) & F.col("__id").eqNullSafe(F.col("first")), "left_semi")
    wanted = wanted.select("digest", "text").dropDuplicates(["digest"])
    similar_edges = similar_texts(clusters.select("digest", "cluster"), wanted, scratch, least)
    found = components(similar_edges, scratch, "text_components").withColumnRenamed("node", "digest")
    roots = scratch.write(found.join(firsts.select("digest", "first"), "digest"), "roots")
    names = roots.groupBy("root").agg(F.min("first").alias("name"))
    named = scratch.write(roots.join(names, "root").select("digest", "name"), "names")
    classes = firsts.select("digest", "first").join(named, "digest", "left").select("digest", F.coalesce("name", "first").alias("name"))
    return prints.select("digest", "id").distinct().join(classes, "digest")


def digest_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (with its repeated rows, if it has any).

    Near copies have at least STAGE_SIMILARITY of their five-word shingles in common (Jaccard), or are
    connected by such pairs. Candidates share a probe key of one of STAGE_SEEDS or more fingerprints (every pair within STAGE_BITS
    bits by any of them does, and at least STAGE_RECALL of the others, whatever the size of the table); each link between them
    is told from both whole shingle sets. Documents that stay are not shuffled, but for those that a bitmap can't tell from others.
    """
    scratch, search = Scratch(spark, "simhash-stage"), Scratch(spark, "simhash-search")
    found = near_copies(docs, search, STAGE_BITS, STAGE_SIMILARITY)
    gone = scratch.write(found.where("not (id <=> name)").select(F.col("digest").alias("__gone"), F.col("id").alias("__id")), "gone")
    search.clear()
    key = F.xxhash64(F.col("doc_id"), F.col("__digest"))
    marked = maybe_among(docs.withColumn("__digest", digest_of("text")).withColumn("__key", key), "__key", gone.select(F.xxhash64("__id", "__gone").alias("id")), scratch, "gone_ids")
    checked = marked.where("__maybe").join(gone, (F.col("__digest") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    return marked.where("not __maybe").select(*docs.columns).unionAll(checked.select(*docs.columns))
