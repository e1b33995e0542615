"""Operator 3, benchmark decontamination: q-gram lemma filtering, then banded alignment.

Texts and passages are case-folded, and what is neither letter nor digit becomes one space. A passage of m
characters within e edits of part of a text shares at least m - q + 1 - q*e of its q-grams with it, on diagonals
(place in the text less place in the passage) that lie within e of each other. So shared q-grams are counted in
bands of diagonals of twice the width e + 1, each overlapping the next by half; bands that reach the
bound are aligned within the band, and kept if at most e edits are needed. A first look at places alone (enough q-grams
of passages of such a length in a stretch that long) spares most of a text the counting. Neither step loses a passage.

A q-gram that a passage repeats more than REPEATS times would pair with itself over and over: it isn't counted, and the passage's
bound is lowered by its places. A passage with no bound left is aligned over all of each stretch that passes the first look.

Passages are dealt into blocks of about ``block_chars`` characters at most; tasks build their indexes, which are written and then
broadcast one at a time: a task holds one block's index. With one block its hits are added to the documents as they pass. With
more, each pass hands out only digests and hits of the texts that hold something, and one join adds them at the end; of the
documents only those that a bitmap can't tell from these are shuffled. Long texts are searched in overlapping stretches.

Defined cases: null and empty texts hold nothing. Passages that are null or have no letter or digit are in no text. Those shorter than q
characters after folding are found verbatim, as whole words. Equal passages are found under each of their ids. For one document
and passage the match of fewest edits, the first of equals, is given. Repeated rows are searched one by one.
An empty table on either side gives no match. Ids of passages may have any type, which the hits have, too. Columns of the benchmark other than id and text are ignored. A
column of the documents with the name of the result raises an error.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import Scratch, maybe_among, slices, trimmed

OTHER = re.compile(r"[\W_]+")
#: Multiplier of the rolling hash, an odd number without structure.
FACTOR = 0x9E3779B97F4A7C15
#: Characters that are searched at a time, and pairs of q-grams that are counted at a time.
STRETCH, PAIRS = 1 << 18, 1 << 19
#: Times that a passage may repeat a q-gram that is counted.
REPEATS = 8


@dataclass(frozen=True)
class Settings:
    q: int = 10
    edit_rate: float = 0.08
    block_chars: int = 4_000_000


def fold(text: str | None) -> str:
    return OTHER.sub(" ", text.casefold()).strip() if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q consecutive codes, put together from those of powers of two."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    n, done, total = len(codes) - q + 1, 0, np.zeros(len(codes) - q + 1, np.uint64)
    part, width = codes.astype(np.uint64) * np.uint64(FACTOR), 1
    while True:
        if q & width:
            total = total * np.uint64(pow(FACTOR, width, 1 << 64)) + part[done : done + n]
            done += width
        if width * 2 > q:
            break
        part = part[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + part[width:]
        width *= 2
    return total ^ (total >> np.uint64(29))


class Index:
    """The q-grams of a block of passages."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings, id_type: pa.DataType | None = None):
        q = self.q = settings.q
        self.id_type = id_type
        kept, short = [(i, t) for i, t in items if len(t) >= q], [(i, t) for i, t in items if 0 < len(t) < q]
        self.ids, self.texts = [i for i, _ in [*kept, *short]], [t for _, t in kept]
        # Passages that are too short for q-grams, by their text, and how many words they have.
        self.short: dict[str, list[int]] = {}
        for k, (_, t) in enumerate(short, len(kept)):
            self.short.setdefault(t, []).append(k)
        self.short_words = sorted({t.count(" ") + 1 for t in self.short})
        lengths = np.array([len(t) for t in self.texts], np.int64)
        # As many edits as the rate allows and as leave the bound at one q-gram or more.
        self.edits = np.minimum((lengths * settings.edit_rate).astype(np.int64), (lengths - q) // q)
        self.lengths, self.bounds = lengths, lengths - q + 1 - q * self.edits
        hashes = [gram_hashes(codes_of(t), q) for t in self.texts]
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes]) if kept else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if kept else np.empty(0, np.int64)
        order = np.lexsort((item, every))
        every, item, place = every[order], item[order], place[order]
        self.hashes = np.unique(every)
        # Runs of one q-gram of one passage; long ones are left out of the counting.
        fresh = np.flatnonzero(np.concatenate(([True], (every[1:] != every[:-1]) | (item[1:] != item[:-1])))[: len(every)])
        runs = np.diff(np.append(fresh, len(every)))
        counted = np.repeat(runs <= REPEATS, runs)
        self.lowered = self.bounds - np.bincount(item[~counted], minlength=len(kept))[: len(kept)]
        self.outright = [(k, np.unique(hashes[k])) for k in np.flatnonzero(self.lowered <= 0).tolist()]
        counted &= self.lowered[item] > 0
        self.item, self.place = item[counted], place[counted]
        self.starts = np.searchsorted(every[counted], self.hashes)
        self.starts = np.append(self.starts, int(counted.sum()))
        # A table by the leading bits lets most other q-grams be passed over before the search.
        self.shift = np.uint64(64 - max(16, min(24, int(len(self.hashes)).bit_length() + 4)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.hashes >> self.shift] = True
        # Passages of like length share a first look: least bound, longest stretch.
        kinds = np.floor(np.log(np.maximum(lengths, 1)) / np.log(1.25)).astype(np.int64)
        self.looks = [(int(self.bounds[kinds == k].min()), int((lengths + self.edits)[kinds == k].max()) - q + 1) for k in np.unique(kinds)]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(passage, edits, start, stop) of matches in a folded text."""
        found: list[tuple[int, int, int, int]] = []
        if not self.texts:
            return found
        hashes = gram_hashes(codes_of(text), self.q)
        at = np.flatnonzero(self.seen[hashes >> self.shift])
        gram = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[gram] == hashes[at]
        at, gram = at[same], gram[same]
        dense = np.zeros(len(at) + 1, np.int64)
        for bound, stretch in self.looks:
            if len(at) >= bound:
                first = np.flatnonzero(at[bound - 1 :] - at[: len(at) - bound + 1] < stretch)
                # Every q-gram of a stretch that holds enough of them stays.
                last = np.searchsorted(at, at[first] + stretch)
                np.add.at(dense, first, 1)
                np.add.at(dense, last, -1)
        stay = np.cumsum(dense)[:-1] > 0
        at, gram = at[stay], gram[stay]
        if not len(at):
            return found
        keys, counts = self._counted(at, gram)
        keys = keys[counts >= self.lowered[keys >> 44]]
        for key in keys.tolist():
            k, b = key >> 44, key & ((1 << 44) - 1)
            edits = int(self.edits[k])
            low = (b - 1) * (edits + 1) - (1 << 40)
            if (hit := align(self.texts[k], text, low, low + 2 * edits + 1, edits)) is not None:
                found.append((k, *hit))
        for k, own in self.outright:
            # Stretches with as many of the passage's q-grams as a match has; each is aligned whole.
            here, bound, span = at[np.isin(hashes[at], own)], int(self.bounds[k]), int(self.lengths[k] + self.edits[k])
            first = np.flatnonzero(here[bound - 1 :] - here[: max(0, len(here) - bound + 1)] < span) if len(here) >= bound else []
            after = -1
            for low in here[first].tolist() if len(first) else []:
                if low >= after:
                    after = low + 4 * span
                    if (hit := align(self.texts[k], text, low - span, after, int(self.edits[k]))) is not None:
                        found.append((k, *hit))
        return found

    def _counted(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((passage, band) keys, q-grams shared in each), some pairs at a time."""
        size = self.starts[gram + 1] - self.starts[gram]
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        total = np.cumsum(size)
        cuts = np.searchsorted(total, np.arange(PAIRS, int(total[-1]) + 1, PAIRS), side="right") if len(total) else []
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            n = size[a:b]
            pair = np.repeat(self.starts[gram[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item, diagonal = self.item[pair], np.repeat(at[a:b], n) - self.place[pair]
            band = (diagonal + (1 << 40)) // (self.edits[item] + 1)
            more, times = np.unique(np.concatenate([(item << 44) | band, (item << 44) | (band + 1)]), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        return keys, counts

    def whole_words(self, text: str) -> list[tuple[int, int, int, int]]:
        """Matches of the short passages in a folded text."""
        words, found = text.split(" "), []
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        for n in self.short_words:
            for i in range(len(words) - n + 1):
                for k in self.short.get(" ".join(words[i : i + n]), ()):
                    found.append((k, 0, int(starts[i]), int(starts[i + n]) - 1))
        return found


def _banded(passage: np.ndarray, text: np.ndarray, low: int, high: int, free_start: bool) -> np.ndarray:
    """Edits of the whole passage against the text, ended at each diagonal from low to high.

    The text may start at any of these diagonals, or only at diagonal 0. Cells off the text cost too much to be used.
    """
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    far = len(passage) + len(text) + 1
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0 if free_start else np.abs(diagonals), far)
    if not free_start:
        row = np.where(diagonals >= 0, row, far)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i in range(1, len(passage) + 1):
        j = i + diagonals
        inside = (j >= 1) & (j <= len(text))
        differs = padded[np.clip(j - 1, 0, len(text))] != passage[i - 1]
        step = np.where(inside, row + differs, far)
        step = np.minimum(step, np.append(row[1:], far) + 1)
        step = np.where((j >= 0) & (j <= len(text)), step, far)
        row = np.minimum(np.minimum.accumulate(step - steps) + steps, far)
        row = np.where((j >= 0) & (j <= len(text)), row, far)
    return row


def align(passage: str, text: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best match on diagonals from low to high, if it needs at most ``edits``."""
    a, b = max(0, low - edits), min(len(text), high + len(passage) + edits)
    part = text[a:b]
    if (exact := part.find(passage)) >= 0:
        return 0, a + exact, a + exact + len(passage)
    if not edits:
        return None
    p, t = codes_of(passage), codes_of(part)
    ends = _banded(p, t, low - edits - a, high + edits - a, True)
    best = int(ends.min())
    if best > edits:
        return None
    stop = int(np.argmin(ends)) + low - edits - a + len(p)
    # The start: the reversed passage against the reversed text before the stop.
    starts = _banded(p[::-1], t[:stop][::-1], -edits, edits, False)
    length = int(np.argmin(starts)) - edits + len(p)
    return best, a + stop - length, a + stop


def _best(matches: list[tuple[int, int, int, int]], ids: list[int | None]) -> list[dict]:
    best: dict[int, tuple[int, int, int]] = {}
    for k, *hit in matches:
        if k not in best or tuple(hit) < best[k]:
            best[k] = tuple(hit)
    return [{"item_id": ids[k], "edits": e, "start": a, "stop": b} for k, (e, a, b) in sorted(best.items())]


def search_texts(index: Index, texts: list[str | None]) -> list[list[dict]]:
    """The best match of each passage in each text. Short texts are searched together, long ones in stretches."""
    reach = int((index.lengths + 2 * index.edits).max()) + index.q if index.texts else 0
    step = max(STRETCH, 4 * reach)
    matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        starts = np.cumsum([0, *(len(t) + 1 for *_, t in held)])
        # Line ends part the texts: folded passages have none, so no match reaches over one.
        for k, edits, start, stop in index.search("\n".join(t for *_, t in held)):
            n = int(np.searchsorted(starts, start, side="right")) - 1
            doc, offset, _ = held[n]
            matches[doc].append((k, edits, start - int(starts[n]) + offset, stop - int(starts[n]) + offset))
        held, size = [], 0

    for n, text in enumerate(texts):
        folded = fold(text)
        if index.short:
            matches[n] += index.whole_words(folded)
        for a in range(0, max(1, len(folded) - reach), step - reach):
            held.append((n, a, folded[a : a + step]))
            size += len(held[-1][2])
            if size >= STRETCH:
                flush()
    flush()
    return [_best(m, index.ids) for m in matches]


def indexes(benchmark: DataFrame, id_col: str, text_col: str, settings: Settings, scratch: Scratch) -> list[DataFrame]:
    """A table of one row for each block of passages: its index, built in a task and written."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # Blocks by hash come out near their mean, which is half of what they may have.
    blocks = 1 if total <= settings.block_chars else -(-2 * total // settings.block_chars)

    def build(passages: pa.Table) -> pa.Table:
        rows = zip(*(passages.column(c).to_pylist() for c in ("id", "text")), strict=True)
        known = sorted(((i, fold(t)) for i, t in rows), key=lambda x: (x[0] is None, x[0] if x[0] is not None else "", x[1]))
        index = Index(known, settings, passages.schema.field("id").type)
        return pa.table({"block": passages.column("block")[:1], "data": pa.array([pickle.dumps(index)], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    built = scratch.write(dealt.groupBy("block").applyInArrow(build, "block int, data binary"), "indexes")
    return [built.where(F.col("block") == b).select("data") for b in range(blocks)]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings(), out: str = "hits"
) -> DataFrame:
    """``docs`` with one more column ``out``: the passages that each text holds, with edits and place in the folded text."""
    spark = docs.sparkSession
    names = docs.columns
    if out in names:
        raise ValueError(f"docs has a column {out} already")
    fields = [T.StructField("item_id", benchmark.schema[item_id].dataType), *(T.StructField(n, t) for n, t in (("edits", T.IntegerType()), ("start", T.LongType()), ("stop", T.LongType())))]
    hits_type, scratch = T.ArrayType(T.StructType(fields)), Scratch(spark, "decontamination")

    def hits_of(index: Index, texts: list[str | None]) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", index.id_type), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(search_texts(index, texts), kind)

    blocks = indexes(benchmark, item_id, item_text, settings, scratch)
    found = []
    for number, block in enumerate(blocks):
        row = block.first()
        if row is None:
            continue
        shared = spark.sparkContext.broadcast(pickle.loads(row["data"]))
        if len(blocks) == 1:

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches, names.index(text_col)):
                    hits = hits_of(shared.value, batch.column(names.index(text_col)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, out])

            return docs.mapInArrow(trimmed(search), T.StructType([*docs.schema.fields, T.StructField(out, hits_type)]))

        def held(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts = batch.column("text").to_pylist()
                hits = hits_of(shared.value, texts)
                some = np.flatnonzero(np.diff(hits.offsets.to_numpy()))
                digests = [hashlib.sha256(texts[i].encode()).hexdigest() for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), hits.take(pa.array(some))], names=["digest", "hits"])

        searched = docs.select(F.col(text_col).alias("text")).mapInArrow(trimmed(held), T.StructType([T.StructField("digest", T.StringType()), T.StructField("hits", hits_type)]))
        # A text may be there often; its hits are the same.
        found.append(scratch.write(searched.groupBy("digest").agg(F.first("hits").alias("hits")), f"hits-{number}"))
    none = F.array().cast(hits_type)
    if not found:
        return docs.withColumn(out, none)
    every = reduce(DataFrame.unionAll, found).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("__hits"))
    every = scratch.write(every.withColumnRenamed("digest", "__held"), "hits")
    marked = maybe_among(docs.withColumn("__digest", F.sha2(F.col(text_col).cast("binary"), 256)), "__digest", every.select(F.col("__held").alias("id")), scratch, "held")
    joined = marked.where("__maybe").join(every, F.col("__digest") == F.col("__held"), "left").select(*names, F.coalesce("__hits", none).alias(out))
    return marked.where("not __maybe").select(*names, none.alias(out)).unionAll(joined)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    found = find_passages(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=f"c{columns.index('text')}")
    return found.where(F.size("hits") == 0).drop("hits").toDF(*columns)
