import random

import numpy as np
import pytest
from differential import connect, differences
from pyspark.sql import functions as F

from millrace.llm import hamming
from millrace.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"


def brute(rows, k, every):
    codes = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None for x in v)]
    bits = np.array([[x > 0 for x in v] for _, v in codes])
    out = []
    for (i, _), own in zip(codes, bits, strict=True):
        if i is not None and i % every == 0:
            order = sorted((int((own != b).sum()), j) for (j, _), b in zip(codes, bits, strict=True) if j is not None)
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(order[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(4)]
    rows = [(i, [-x if rng.random() < 0.1 else x for x in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, centres[0]) for i in range(40)]  # a hot code
    rows += [(7, centres[1]), (7, centres[1]), (None, centres[1]), (None, None), (400, None), (500, [1.0]), (600, []), (700, [None] * 64), (800, [0.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("clash")).withColumn("query", F.lit(1))
    got = hamming.nearest(table, F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == brute(rows, 7, 20)


def test_outliers(spark, monkeypatch):
    """Queries far from every code are compared with all; ties at the kth place go to the smaller id."""
    rng = random.Random(2)
    centre = [rng.choice([-1.0, 1.0]) for _ in range(64)]
    rows = [(i, [-x if rng.random() < 0.04 else x for x in centre]) for i in range(1500)]
    rows += [(2000 + 20 * i, [-x if rng.random() < 0.8 else x for x in centre]) for i in range(3)]
    asked = []
    plain = hamming.compared
    monkeypatch.setattr(hamming, "choose_segments", lambda *_: 3)
    monkeypatch.setattr(hamming, "compared", lambda codes, state, *rest: (asked.append(state.count()), plain(codes, state, *rest))[1])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = hamming.nearest(table, F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == brute(rows, 7, 20)
    assert asked and 0 < asked[0] <= 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_compared_keeps_k_a_task(spark, kind):
    """Several batches a task and several blocks of queries: each task hands out k rows a query, and they are the nearest."""
    rng = random.Random(5)
    codes = [(rng.getrandbits(63), i if kind == "long" else f"{i:05}") for i in range(3000)]
    table = spark.createDataFrame([(c, [i]) for c, i in codes], f"code long, ids array<{kind}>").repartition(2)
    asked = [c for c, _ in codes[:40]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        state = spark.createDataFrame([(c,) for c in asked], "query long")
        got = hamming.compared(table, state, 4, Scratch(spark, "test_hamming"), queries=15).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(q, c, i, d) for q in asked for d, i, c in sorted(((q ^ c).bit_count(), i, c) for c, i in codes)[:4]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    task = hamming.nearest_of(table, np.array(asked), 4)
    assert task.count() == 2 * 40 * 4


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_probes_sent_or_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(hamming, "SENT_PROBES", sent)
    assert not differences(hamming.op4_topk_search(spark, SMALL), connect(SMALL), hamming.ORACLE)


def test_probes_are_all_values_at_a_distance(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PROBES", 5)
    looking = spark.createDataFrame([(1, 64, 0, 5), (2, 64, 1, 9), (3, 64, 0, 0)], "query long, worst int, seg int, value long")
    for radius in (0, 1, 2):
        got = sorted((r["query"], r["at"], r["probe"]) for r in hamming.probes_of(looking, radius, [6, 4]).collect())
        want = sorted((q, s, v) for q, s, at, w in ((1, 0, 5, 6), (2, 1, 9, 4), (3, 0, 0, 6)) for v in range(1 << w) if (v ^ at).bit_count() == radius)
        assert got == want


def test_few_and_no_rows(spark):
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hamming.nearest(table, F.col("vec_id") == 0, k=5).collect()
    assert sorted((r["rank"], r["vec_id"], r["distance"]) for r in got) == [(1, 0, 0), (2, 1, 64)]
    assert hamming.nearest(table.where("false"), F.col("vec_id") == 0).count() == 0
    assert hamming.nearest(table, F.col("vec_id") == 9).count() == 0
