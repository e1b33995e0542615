import random

import numpy as np
import pytest
from differential import connect, differences

from millrace.llm import quantizer

SMALL = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes and errors by plain comparison with every entry; rows are (id, vector, label)."""
    kept = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64), g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cuts = quantizer.cut(len(kept[0][1]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    books = [np.array([r[1][c] for r in first]) for c in cuts]
    x = np.array([r[1] for r in kept])

    def assign():
        return [((x[:, None, c] - book[None]) ** 2).sum(axis=2) for book, c in zip(books, cuts, strict=True)]

    for _ in range(rounds):
        for p, (apart, c) in enumerate(zip(assign(), cuts, strict=True)):
            near = apart.argmin(axis=1)
            for e in set(near.tolist()):
                mine = x[near == e][:, c]
                books[p][e] = mine.sum(axis=0) // len(mine)
    last = assign()
    codes = ["".join(f"{k:02x}" for k in ks) for ks in zip(*(a.argmin(axis=1).tolist() for a in last), strict=True)]
    errors = sum(a.min(axis=1) for a in last).tolist()
    return [(r[0], c, e, r[2]) for r, c, e in zip(kept, codes, errors, strict=True)], books


def ordered(rows):
    return sorted(rows, key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, id int, code string, error string, vector string, part int")


def made(rng, count, dims=16, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(count)]


def widened(rows):
    return [(*r, 1, "c", "e", "v", 2) for r in rows]


@pytest.mark.parametrize("kept_cells", [3, 1 << 15])
@pytest.mark.parametrize("dims", [16, 10])
def test_against_brute_force(spark, kept_cells, dims):
    """Also with a memo that is too small for a block, and with parts that aren't equal."""
    rows = made(random.Random(dims), 700, dims)
    rows += [(1000 + i, rows[0][1], None) for i in range(300)]  # a hot vector
    rows += [(5, rows[1][1], 1), (5, rows[1][1], 1), (None, rows[2][1], 2)]
    odd = [(2000, None, 1), (2001, [None] * dims, 1), (2002, [float("nan")] * dims, 1), (2003, [float("inf")] + [0.0] * (dims - 1), None), (2004, [], 1), (2005, [1.0], 1)]
    got, books = quantizer.encode(vectors(spark, widened(rows + odd)).repartition(5), keep={"label": "label"}, entries=64, kept_cells=kept_cells)
    want, want_books = brute(rows, entries=64)
    assert ordered((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label"]) for r in got.collect()) == ordered(want)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))


def test_ties_go_to_the_lower_entry(spark):
    """Integers on a small lattice are often equally near to several entries."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-3, 4) / 1024 for _ in range(8)], 0) for i in range(400)]
    got, _ = quantizer.encode(vectors(spark, widened(rows), "double"), keep={"label": "label"}, entries=100)
    want, _ = brute(rows, entries=100)
    assert ordered((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label"]) for r in got.collect()) == ordered(want)


def test_only_dominated_entries_are_left_out():
    """Every point of a cell has its nearest entries among those kept for the cell, and in small cells few are kept."""
    rng = np.random.default_rng(5)
    book = rng.integers(-300, 300, (64, 3))
    cells = quantizer.Cells(book)
    assert cells.bits >= 3
    grid = rng.integers(-300, 300, (50, 3)) >> cells.bits
    for g, kept in zip(grid, cells.undominated(grid), strict=True):
        inside = (g << cells.bits) + rng.integers(0, 1 << cells.bits, (200, 3))
        apart = ((inside[:, None] - book[None]) ** 2).sum(axis=2)
        nearest = np.flatnonzero((apart == apart.min(axis=1, keepdims=True)).any(axis=0))
        assert set(nearest.tolist()) <= set(kept.tolist())
        assert len(kept) < len(book) / 2
    plain = quantizer.Cells(book)
    again = plain.nearest(np.repeat(grid[:1] << cells.bits, 9, axis=0))
    assert len(plain.memo) == 1 and len(set(again[0].tolist())) == 1


def test_few_and_no_rows(spark):
    table = vectors(spark, widened([(0, [1.0] * 8, 1), (1, [-1.0] * 8, None)]))
    got, books = quantizer.encode(table)
    assert sorted((r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in got.collect()) == [(0, "00000000", 0), (1, "01010101", 0)]
    assert [b.shape for b in books] == [(2, 2)] * 4
    for empty in (table.where("false"), vectors(spark, widened([(1, None, 1)]))):
        got, _ = quantizer.encode(empty, keep={"label": "label"})
        assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(ValueError):
        quantizer.encode(vectors(spark, widened([(0, [1e30] * 8, 1)])))


def test_like_sql(spark):
    assert not differences(quantizer.op12_vector_codes(spark, SMALL), connect(SMALL), quantizer.ORACLE)
