"""Operator 12, vector code compression: product quantisation with memoised grid cells.

Vectors are scaled to integers and cut into parts; each part's codebook is trained by Lloyd rounds and a part's code
is its nearest entry. All arithmetic is on integers, so results don't depend on the order of rows or tasks.

To find the nearest entry, a part falls into a cell of a coarse grid, a box. An entry whose least distance to the box
is more than some other entry's greatest distance to it is nearest to nothing in the box: it is dominated. The entries that
aren't are worked out once a cell and kept under the cell's hash; a part is then compared exactly with those only. Ties go to the
lower index, which can't be dominated by what is as near. The grid's width follows the codebook: a box's diagonal is
about a quarter of the distance from an entry to the next. A task keeps at most ``kept_cells`` cells; a full memo starts anew, which
costs time only.

A round is one pass over the vectors: tasks emit sums and counts of each entry they used, Spark adds them up, and only the
codebooks, ``parts * entries`` rows whatever the table, go through the driver and are broadcast.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Of vectors with different numbers of
components those of the most frequent number (ties: the smaller) are kept. If that isn't divisible by the number of parts, the first parts are one longer.
Rows without id are coded, and come last where codebooks start. Repeated rows and ids are answered row by row; of equal
ids the lesser vector comes first. With fewer rows than entries the codebooks are smaller. An empty table gives no rows.
Components whose integers have 2**27 or more in absolute value can't be multiplied exactly and raise an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 27
#: Cells that a task keeps for each part, cells whose entries are worked out at a time, and rows that are coded at a time.
KEPT_CELLS, NEW_CELLS, ROWS = 1 << 15, 256, 4096
#: Slices of a label's rows, so that no task joins all rows of one label with their sum.
SALT = 32

Codebook = np.ndarray  # entries x width, integers


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """Rows of integers from lists of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1)


def cut(dims: int, parts: int) -> list[slice]:
    """Consecutive parts; the first ones are longer by one if the parts can't be equal."""
    bounds = [0]
    for k in range(parts):
        bounds.append(bounds[-1] + dims // parts + (k < dims % parts))
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cell_bits(book: Codebook) -> int:
    """log2 of the grid's width for a codebook."""
    if len(book) < 2 or not book.shape[1]:
        return 0
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    width = sqrt(float(np.median(apart.min(axis=1)))) / (4 * sqrt(book.shape[1]))
    return max(0, floor(log2(width))) if width > 0 else 0


class Cells:
    """The entries of one codebook that may be nearest, memoised by cell."""

    def __init__(self, book: Codebook, kept_cells: int = KEPT_CELLS):
        self.book, self.bits, self.kept_cells = book, cell_bits(book), kept_cells
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (a row of grid numbers), the entries that no other entry dominates over its box, ascending.

        Twice the distance to an end of the box, or of the nearest point in it, is told from the box's middle and width, without halves.
        """
        reach = np.int64((1 << self.bits) - 1)
        middle = (cells << (self.bits + 1)) + reach
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            away = np.abs(2 * self.book[None, :, d] - middle[:, d, None])
            most += (away + reach) ** 2
            away -= reach
            np.maximum(away, 0, out=away)
            least += away * away
        alive = least <= most.min(axis=1, keepdims=True)
        row, entry = np.nonzero(alive)
        return np.split(entry, np.searchsorted(row, np.arange(1, len(cells))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cells = np.ascontiguousarray(x >> self.bits)
        size = cells.shape[1] * cells.itemsize
        data = cells.tobytes()
        keys = [data[i : i + size] for i in range(0, len(data), size)] if size else [b""] * len(x)
        new = list({k: i for i, k in enumerate(keys) if k not in self.memo}.items())
        if len(self.memo) + len(new) > self.kept_cells:
            self.memo = {}
            new = list({k: i for i, k in enumerate(keys)}.items())
        for a in range(0, len(new), NEW_CELLS):
            some = new[a : a + NEW_CELLS]
            self.memo.update(zip((k for k, _ in some), self.undominated(cells[[i for _, i in some]]), strict=True))
        choices = [self.memo[k] for k in keys]
        counts = np.fromiter(map(len, choices), np.int64, len(choices))
        entry, row = np.concatenate(choices), np.repeat(np.arange(len(x)), counts)
        apart = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(apart, np.cumsum(counts) - counts)
        at = np.flatnonzero(apart == best[row])
        first = at[np.unique(row[at], return_index=True)[1]]
        return entry[first], best


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, integers(part.column("vector"), scale)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, others: dict[str, str], scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, vector and the others under their new names) of rows that can be coded, and the number of their components."""
    value = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *(F.col(c).alias(n) for c, n in others.items()))
    rows = rows.where(value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(F.size(value).alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform(value, F.abs)).cast("double")).alias("most"))
    found = sizes.orderBy(F.desc("n"), "dims").limit(1).collect()
    if not found:
        return rows.where("false"), 0
    if found[0]["most"] is not None and found[0]["most"] * scale >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} or more can't be coded exactly")
    return rows.where(F.size(value) == found[0]["dims"]), found[0]["dims"]


def retrained(rows: DataFrame, books: list[Codebook], cuts: list[slice], scale: int, kept_cells: int) -> list[Codebook]:
    """The codebooks after one round: each used entry becomes the mean of its parts, every component rounded down."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(books)
    width = max(c.stop - c.start for c in cuts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, kept_cells) for book in shared.value]
        counts = [np.zeros(len(c.book), np.int64) for c in cells]
        sums = [np.zeros((len(c.book), width), np.int64) for c in cells]
        for _, x in _blocks(batches, scale):
            for p, c in enumerate(cuts):
                entry, _ = cells[p].nearest(x[:, c])
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                by = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[by], return_index=True)
                sums[p][used, : c.stop - c.start] += np.add.reduceat(x[by, c], first, axis=0)
        part, entry = (np.concatenate(a) for a in zip(*((np.full(len(u), p), u) for p, u in ((p, np.flatnonzero(n)) for p, n in enumerate(counts))), strict=True))
        flat = np.concatenate([s[n > 0] for s, n in zip(sums, counts, strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
        n = np.concatenate([c[c > 0] for c in counts])
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n), lists], names=["part", "entry", "n", "sums"])

    used = rows.select("vector").mapInArrow(assign, "part int, entry int, n long, sums array<long>")
    total = used.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    after = [book.copy() for book in books]
    for part, entry, n, sums in total.collect():
        after[part][entry] = [s // n for s in sums[: after[part].shape[1]]]
    return after


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: dict[str, str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    kept_cells: int = KEPT_CELLS,
) -> tuple[DataFrame, list[Codebook]]:
    """(id, ``code`` as binary of one byte a part, ``error``, and ``keep``: columns of the table by their new names), and the codebooks.

    Codebooks start with the vectors of the smallest ids; ``entries`` is at most 256.
    """
    spark = vectors.sparkSession
    keep = keep or {}
    rows, dims = kept_vectors(vectors, id_col, vector_col, keep, scale)
    cuts = cut(dims, parts)
    # A bounded number of rows, whatever the table: the start of the codebooks.
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.floor(np.array([r[0] for r in first], np.float64).reshape(len(first), dims) * scale).astype(np.int64)
    books = [start[:, c].copy() for c in cuts]
    for _ in range(rounds if first else 0):
        books = retrained(rows, books, cuts, scale, kept_cells)
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, kept_cells) for book in shared.value]
        for part, x in _blocks(batches, scale):
            found = [cells[p].nearest(x[:, c]) for p, c in enumerate(cuts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            columns = [part.column(c) for c in ("id", *keep.values())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", *keep.values(), "code", "error"])

    schema = rows.select("id", *keep.values()).schema.add("code", "binary").add("error", "long")
    return rows.mapInArrow(code, schema).withColumnRenamed("id", id_col), books


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, the error of each label, and the digest of the codebooks."""
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep={"label": "label"})
    coded = Scratch(spark, "vector-codes").write(coded, "coded")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    dealt = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("share"))
    own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)) == F.col("share")
    return coded.join(dealt, F.col("label").eqNullSafe(F.col("of")) & own).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The rounds written out one after the other; a distance and its entry are one number, so that ties go to the lower entry."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), cuts AS MATERIALIZED (
  SELECT vec_id, part, v[part * 16 + 1 : part * 16 + 16] AS x FROM kept, (SELECT unnest(range(4)) AS part)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM cuts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""]
    for k in range(5):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, min(far * 256 + entry) AS best FROM (
    SELECT vec_id, c.part, x, entry, list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS far
    FROM cuts c JOIN book{k} b ON c.part = b.part
  ) GROUP BY vec_id, part
)""")
        if k < 4:
            steps.append(f"""sums{k} AS (
  SELECT part, best % 256 AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 17)) AS i)
  GROUP BY part, best % 256, i
), means{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{k} GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m, e) AS e FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH {", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE = _oracle()
