import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import forest


def brute(rows, k, every):
    """All true neighbours, {query id: [(id, score), ...]}; rows are (id, vector)."""
    kept = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x, ids = np.array([v for _, v in kept]), np.array([i for i, _ in kept])
    out = {}
    for i, v in kept:
        if i % every == 0:
            near = ids != i
            score = (x[near] * v).sum(axis=1)
            out[i] = [(int(ids[near][j]), float(score[j])) for j in np.lexsort((ids[near], -score))[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, query int, score double").repartition(3)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(forest.op13_nearest_neighbours(spark, sf_dir)), brute(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    true = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(np.dot(np.array(true[q], np.float64), np.array(true[i], np.float64)) - s) < 1e-12 for i, s in found)


def test_norms_matter_and_few_rows_are_compared(spark):
    """Groups of near vectors with norms from 0.1 to 10: the largest inner products aren't the smallest angles."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    rows = []
    for i in range(4000):
        c, size = rng.choice(centres), rng.choice([0.1, 1.0, 10.0])
        rows.append((i, [size * (x + rng.gauss(0, 0.3)) for x in c]))
    got, want = answers(forest.nearest(table(spark, rows, "double"), F.col("vec_id") % 50 == 0, k=10)), brute(rows, 10, 50)
    assert recall(got, want) >= 0.9
    x = np.array([v for _, v in rows])
    norm = np.sqrt((x * x).sum(axis=1).max())
    planes = forest.projections(25)
    trees = forest.Forest(x, norm, planes)
    asked = forest.strings(forest.asked(x[::50]), planes)
    for share in (0.01, 0.05):
        assert np.mean([len(near) for _, near in trees.candidates(asked, share)]) < len(x) / 2


def test_ranges_and_needs():
    """Ranges are the rows that share a prefix; a row is a candidate for just the shares that it needs or more."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6)) + rng.integers(0, 2, (400, 1)) * 3
    planes = forest.projections(7)
    trees = forest.Forest(x, 20.0, planes)
    of = forest.strings(forest.raised(x, 20.0), planes)
    asked = forest.strings(forest.asked(x[:9]), planes)
    for depth in range(1, forest.LETTERS + 1):
        start, end = trees.ranges(asked, depth)
        cut = trees.letters ** (forest.LETTERS - depth)
        for t in range(0, forest.TREES, 5):
            for q in range(9):
                assert set(trees.order[t, start[t, q] : end[t, q]].tolist()) == set(np.flatnonzero(of[t] // cut == asked[t, q] // cut).tolist())
    rows = [np.arange(0, 400, 7)] * 9
    needs = trees.needs(asked, rows)
    for q in range(9):
        for row, need in zip(rows[q].tolist(), needs[q].tolist(), strict=True):
            for share, there in ((need, True), (need - 1e-6, False)):
                if share >= 0:
                    assert (row in dict(trees.candidates(asked, share))[q]) == there


def test_ties_copies_and_what_takes_no_part(spark):
    """With all rows as candidates the answer is exact, however rows fall into blocks and tasks."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(5)]) for i in range(300)]
    rows = [(i, v if any(v) else [1.0] * 5) for i, v in rows]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a hot vector
    odd = [(20, None), (2000, [0.0] * 5), (2001, [None] * 5), (2020, [float("nan")] * 5), (2040, [float("inf")] * 5), (None, [1.0] * 5), (2060, []), (2080, [9.0])]
    got = answers(forest.nearest(table(spark, rows + odd), F.col("vec_id") % 20 == 0, k=7, share=forest.TREES + 1, block_rows=37))
    assert got == brute(rows, 7, 20)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = answers(forest.nearest(table(spark, rows), F.col("vec_id") == 0))
    assert got == {0: [(1, 0.5), (2, -1.0)]}
    again = table(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])])
    assert answers(forest.nearest(again, F.col("vec_id") == 0)) == {0: [(1, 0.5), (1, 0.5)]}
    assert forest.nearest(table(spark, rows[:1]), F.col("vec_id") == 0).count() == 0
    for none in (table(spark, rows).where("false"), table(spark, [(1, None)])):
        assert forest.nearest(none, F.col("vec_id") == 0).count() == 0
    found = forest.nearest(table(spark, rows), F.col("vec_id") == 9)
    assert found.count() == 0 and found.columns == ["query_id", "rank", "vec_id", "score"]
