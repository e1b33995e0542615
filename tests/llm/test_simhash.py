import random

import numpy as np
import pytest
import xxhash

from millrace.llm import linking, simhash
from millrace.llm.components import components
from millrace.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"


def plainly(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, max_bits):
    """The smallest reachable index of each value, by comparing all."""
    v = np.array(values, np.uint64)
    near, label = np.bitwise_count(v[:, None] ^ v[None, :]) <= max_bits, np.arange(len(v))
    while True:
        low = np.where(near, label[None, :], len(v)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def test_fingerprint():
    rng = random.Random(1)
    for text in ["", " \n", "a", "A b", "a\x0bb\x0cc d", "É é ÀB Ⅷ", "x " * 20_000, "a b c d e", *("".join(rng.choice("abAB \n\té") for _ in range(rng.randint(1, 200))) for _ in range(200))]:
        assert simhash.fingerprint(text.encode()) == plainly(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize(("max_bits", "bucket"), [(0, 2048), (1, 2048), (2, 2048), (2, 3), (3, 3), (6, 2048)])
def test_links_against_brute_force(spark, max_bits, bucket):
    """Clusters, chains and noise, with values that crowd under one key."""
    rng = random.Random(max_bits)
    values = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(5):
        v = rng.getrandbits(64)
        for _ in range(40):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) if rng.random() < 0.7 else 1 << rng.randrange(20)
            values.add(v)
    values = sorted(values | {0, (1 << 64) - 1})
    table = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    scratch = Scratch(spark, "test_simhash")
    roots = {r["node"]: r["root"] for r in components(simhash.links(table, scratch, max_bits, bucket), scratch).collect()}
    mine = [roots.get(simhash.signed(v), simhash.signed(v)) for v in values]
    want = groups(values, max_bits)
    assert len(set(mine)) == len(set(want)) and len(set(zip(mine, want, strict=True))) == len(set(want))


def test_allocation_has_the_sum_and_the_least_cost():
    cost, chosen = simhash.allocate([16] * 4, 1000, [10**9, 10, 10, 10], [[0] * 3] * 4, 2)
    assert sum(chosen) == 2 - 4 + 1 and chosen[0] == -1
    assert cost == simhash.allocate([16] * 4, 1000, [10, 10, 10, 10**9], [[0] * 3] * 4, 2)[0]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(250)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test_components")).collect()}
    assert all(got[x] == root(x) for e in edges for x in e if e[0] != e[1])
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test_components")).count() == 0


def test_odd_rows(spark, odd_documents, no_documents):
    got = simhash.near_duplicates(odd_documents)
    rows = odd_documents.collect()
    assert got.count() == len(rows)
    ids = [r["doc_id"] for r in rows]
    prints = [plainly(r["text"]) for r in rows]
    label = groups(prints, 2)
    want = sorted((i if i is not None else -1, f"{p:016x}", min((j for j, k in zip(ids, label, strict=True) if k == label[n] and j is not None), default=None)) for n, (i, p) in enumerate(zip(ids, prints, strict=True)))
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got.collect()) == want
    assert simhash.near_duplicates(no_documents).count() == 0


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    prints = [plainly(t) for _, t in docs]
    label = groups(prints, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", docs[k][0]) for (i, _), p, k in zip(docs, prints, label, strict=True)}


def brute_links(data, near):
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if near(data[i], data[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("block_rows", [1024, 16, 5])
def test_group_links_of_crowded_groups(spark, block_rows):
    """A large group of near copies with a second family, stragglers and chains beside it, in one block and in many."""
    rng = random.Random(block_rows)
    centres = [rng.getrandbits(128) for _ in range(3)]
    flipped = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(128), n))
    codes = [flipped(centres[0], rng.randint(0, 9)) for _ in range(70)] + [flipped(centres[1], rng.randint(0, 9)) for _ in range(25)] + [rng.getrandbits(128) for _ in range(10)]
    for _ in range(15):
        codes.append(flipped(codes[-1], 11))
    rows = [(g, n, v.to_bytes(16, "little")) for g in (1, 2) for n, v in enumerate(codes)] + [(3, 7, codes[0].to_bytes(16, "little"))]
    table = spark.createDataFrame(rows, "grp long, node long, data binary")
    edges = linking.group_links(table, Scratch(spark, "test_linking"), "t", linking.hamming_forest(12), block_rows).collect()
    label = list(range(len(codes)))
    for a, b in ((r["a"], r["b"]) for r in edges):
        x, y = sorted((label[a], label[b]))
        label = [x if z == y else z for z in label]
    want = brute_links(codes, lambda a, b: (a ^ b).bit_count() <= 12)
    assert label == want
    if block_rows >= len(codes):
        assert len(edges) < 2 * len(codes), "one block a group gives a forest"


def test_majorities_of_many_rows():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, (1000, 3), dtype=np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[:, c]) > 1000) for c in range(3)]
    assert simhash.majorities(hashes).tolist() == want
