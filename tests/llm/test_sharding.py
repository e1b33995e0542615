import heapq
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import sharding


def one_by_one(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        _, i = heapq.heappop(heap)
        loads[i] += size
        heapq.heappush(heap, (loads[i], i))
    return loads


def test_runs_give_the_loads_of_single_steps():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [s for s in (rng.choice([8, 9, 50, 51, 400, rng.randint(8, 8000)]) for _ in range(12)) for _ in range(rng.choice([1, 2, 30, 500]))]
        shards = rng.choice([1, 2, 7, 24])
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        loads = [0] * shards
        for kind, ends in sharding.schedule([(s, n, s * n) for s, n in counts.items()], shards):
            assert ends[-1] == counts[kind]
            for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                loads[i] += kind * (b - a)
        assert sorted(loads) == sorted(one_by_one(sizes, shards))


def check(rows, got, shards):
    assert len(got) == len(rows)
    texts = defaultdict(set)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    slots = defaultdict(list)
    for r in got:
        text = by_id[r["doc_id"]][0]
        size = 8 + (0 if text is None else len(text.encode()))
        assert r["size"] == size and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        texts[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ties_go_to_the_lowest_shard():
    assert sharding.schedule([(8, 3, 24)], 5) == [(8, [1, 2, 3, 3, 3])]


def test_large_sizes_are_rounded_within_the_bound(spark):
    rng = random.Random(8)
    rows = [(i, f"{i:06}" + "x" * rng.choice([20, 300, rng.randint(9_000, 60_000)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    best = max(one_by_one([8 + len(t) for _, t in rows], 7))
    for bits in (5, 13):
        loads = defaultdict(int)
        for r in sharding.shard_documents(docs, 7, size_bits=bits).collect():
            loads[r["shard"]] += r["size"]
        assert max(loads.values()) <= best * (1 + 2.0 ** (2 - bits))


def test_repeated_rows_are_dealt_out(spark):
    rows = [(1, "same")] * 500 + [(2, "other"), (None, None), (None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")), 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.where("doc_id is not null").collect()]
    check(rows, sharding.shard_documents(odd_documents.where("doc_id is not null"), 5).collect(), 5)
    assert sharding.shard_documents(odd_documents, 5).count() == odd_documents.count()


def test_empty(no_documents):
    assert sharding.shard_documents(no_documents).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sharding.op5_sharding(spark, sf).collect()
    check(rows, got, 24)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += 8 + len(t.encode())
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    best = one_by_one(groups.values(), 24)
    assert max(loads.values()) <= max(best) * 1.005
