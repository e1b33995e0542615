"""Operator 10, substring dedup: words in windows that an earlier document holds are removed, found by phrase automata.

A window is ``WINDOW`` consecutive words. The steps:

1. Anchors. Each window names the ``ANCHOR``-word phrase of least hash in it, so equal windows name equal
   phrases. Phrases named in two different texts are kept, as a bitmap of bounded size: it may let too many
   through but never too few.
2. Confirmation. Windows whose anchor is in the bitmap are grouped by hash; they travel as one row for each
   stretch with one anchor. A window of two or
   more documents recurs; its first place (smallest document, then position) is its source. The most common
   windows, found among those of anchors that step 1 counted most, get it before by a combined minimum; they are so few
   that their places are broadcast, and a document is routed once to each place's chunk, so no window fills a task.
3. Automata. Sources are dealt to shards of about ``windows_per_shard`` windows. Each task compiles a shard's passages
   (sources that follow one another) into an Aho-Corasick automaton over words and streams through it every part of a document
   that was found to share windows with the shard; shards with many parts are salted. A part has the windows that start in
   ``PART`` words that follow one another, so it overlaps the next one and holds its windows whole. The automaton
   looks for seeds, phrases so placed that each window of a passage has one, and matches are extended word by word, so
   no hash decides a removal. Each match of a window or more from a smaller document covers its words.
4. Covered runs are joined with their texts once more to cut them out.

Texts with the same words are known by a digest: those after the first lose all their words if they have a
window, and don't take part in steps 1 to 4 on that account. Rows go by (id, hash of the text), so repeated rows are cut alike.

Defined cases: null, empty and blank texts have no words. Texts with fewer words than a window lose none. Rows
without an id are neither sources nor cut. Rows that repeat an id never cut one another. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from millrace.llm.shared import Scratch, bitmap, maybe_among, partitions, slices, trimmed

WINDOW, ANCHOR = 13, 4
#: Words of a phrase that the automata look for: every window has a whole one if they stand this far apart.
SEED = (WINDOW + 1) // 2
#: Bytes of text that a task hashes at a time, and words of a long text taken together.
BLOCK, SEGMENT = 1 << 18, 50_000
#: Positions of one document that stay in one shard.
CHUNK = 16_384
#: Windows of a document that are sent to a shard together; it divides CHUNK.
PART = 256
MAX_BITMAP_BITS = 26
#: What is in more places than the larger of COMMON and a MOST_COMMON-th of all is common: fewer than MOST_COMMON are.
COMMON, MOST_COMMON = 4096, 1 << 20

_rng = np.random.default_rng(20)
BASE = int(_rng.integers(1 << 62)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base & ((1 << 64) - 1), np.uint64))))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Windows:
    """All windows of a block of texts: their hashes, their anchors and where they stand.

    The hash of consecutive words is that of their bytes joined by single spaces: a polynomial taken from
    running sums and brought to a common place by the inverse of the base.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes, int]]):
        rows, offsets, texts, counts = zip(*pieces, strict=True)
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTES[data] * _powers(BASE, len(data))[:-1])))
        self.back = _powers(INVERSE, len(data))
        gaps = np.flatnonzero((data == 32) | (data == 10))
        self.starts, self.stops = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        piece = np.repeat(np.arange(len(pieces)), counts)
        n = len(piece) - WINDOW + 1
        whole = np.flatnonzero(piece[WINDOW - 1 :] == piece[:n]) if n > 0 else np.empty(0, np.int64)
        first = np.cumsum(counts) - counts
        self.whole = whole
        self.row = np.array(rows)[piece[whole]]
        self.at = np.array(offsets)[piece[whole]] + whole - first[piece[whole]]
        phrases = self.hash(ANCHOR)
        best, place = phrases[whole], whole.copy()
        for j in range(1, WINDOW - ANCHOR + 1):
            other = phrases[whole + j]
            less = other < best
            best, place = np.where(less, other, best), np.where(less, whole + j, place)
        self.anchor, self.anchor_at = best, place

    def hash(self, words: int) -> np.ndarray:
        """The hash of each run of so many words, by its first word; runs over a text's end mean nothing."""
        n = max(0, len(self.starts) - words + 1)
        start = self.starts[:n]
        return _mix((self.sums[self.stops[words - 1 :]] - self.sums[start]) * self.back[start])


def windows(texts: list[list[bytes]]) -> Iterator[Windows]:
    held: list[tuple[int, int, bytes, int]] = []
    size = 0
    for row, words in enumerate(texts):
        for a in range(0, len(words) - WINDOW + 1, SEGMENT):
            part = words[a : a + SEGMENT + WINDOW - 1]
            held.append((row, a, b" ".join(part), len(part)))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield Windows(held)
                held, size = [], 0
    if held:
        yield Windows(held)


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    """bytes.split parts at exactly the white space meant here."""
    for x in column:
        yield (x.as_py() or b"").split()


def _batches(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) for runs of texts of bounded length, or of one text."""
    start, held, size = 0, [], 0
    for n, words in enumerate(_words(column)):
        held.append(words)
        size += len(words)
        if size >= SEGMENT:
            yield start, held
            start, held, size = n + 1, [], 0
    if held:
        yield start, held


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the text as bytes and a hash that tells apart rows with one id."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def profiles(rows: DataFrame) -> DataFrame:
    """(id, key, n_words, digest): the digest is SHA-256 of the words joined by one space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for words in _words(batch.column("text")):
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["id", "key", "n_words", "digest"])

    return rows.mapInArrow(trimmed(make), rows.drop("text").schema.add("n_words", "long").add("digest", "binary"))


def anchors(rows: DataFrame) -> DataFrame:
    """(phrase, text): hashes of each anchor and of the text that it stands in."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch.column("text")):
                known = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in texts], np.uint64)
                for found in windows(texts):
                    _, first = np.unique(found.anchor_at, return_index=True)
                    columns = [found.anchor[first].view(np.int64), known[found.row[first]].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["phrase", "text"])

    return rows.select("text").mapInArrow(trimmed(make), "phrase long, text long")


def _is_common(counted: DataFrame) -> Column:
    return F.col("n") > max(COMMON, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_COMMON)


def common_anchors(recurring: DataFrame) -> np.ndarray:
    """The anchors in most places, in order; fewer than MOST_COMMON whatever the corpus."""
    common = recurring.where(_is_common(recurring)).select("phrase").toArrow()
    return np.sort(common.column("phrase").to_numpy().view(np.uint64))


class Places:
    """First places of the windows in most places (fewer than MOST_COMMON): by hash, and what they have in common."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        hashes = table.column("window").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        numbers: dict[tuple[object, int], int] = {}
        spots = zip(table.column("id").to_pylist(), table.column("at").to_pylist(), strict=True)
        group = [numbers.setdefault((i, at // CHUNK), len(numbers)) for i, at in spots]
        self.group = np.array(group, np.int64)[order]
        self.sources = pa.array([i for i, _ in numbers], table.schema.field("id").type)
        self.chunks = pa.array([c for _, c in numbers], pa.int32())


def _marked(rows: DataFrame, recurring: np.ndarray, bits: int, common: np.ndarray, schema: str, made, places: Places | None = None, fold=None) -> DataFrame:
    """What ``made`` gives for windows whose anchor is in the bitmap, put through ``fold`` if there is one.

    It gets the batch's ids, the windows' rows, hashes, places, anchors and the anchors' places, the common anchors and the places of common windows.
    """
    shared = rows.sparkSession.sparkContext.broadcast((recurring, common, places))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(each(batches)) if fold else each(batches)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (marks, common, places), shift = shared.value, np.uint64(64 - bits)
        for batch in batches:
            for start, texts in _batches(batch.column("text")):
                for found in windows(texts):
                    at = found.anchor >> shift
                    kept = np.flatnonzero((marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                    spots = (start + found.row[kept], found.hash(WINDOW)[found.whole[kept]], found.at[kept].astype(np.int32), found.anchor[kept], found.anchor_at[kept])
                    yield from made(batch.column("id"), *spots, common, places)

    kept = rows.where("id is not null").select("id", "text")
    return kept.mapInArrow(trimmed(make), schema.format(kept.schema["id"].dataType.simpleString()))


def _spots(ids: pa.Array, row: np.ndarray, hashes: np.ndarray, at: np.ndarray, anchor: np.ndarray, anchor_at: np.ndarray, common: np.ndarray, places: None) -> Iterator[pa.RecordBatch]:
    kept = np.isin(anchor, common)
    row, hashes, at = row[kept], hashes[kept], at[kept]
    doc = ids.take(pa.array(row))
    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), doc, pa.array(at), doc, pa.array(np.ones(len(row), np.int64))], names=["window", "id", "at", "last", "n"])


def _folded(table: pa.Table) -> pa.Table:
    """One row a window: its first place, its largest document and the count of its places."""
    table = table.combine_chunks()
    known = pa.chunked_array([table.column("id").combine_chunks(), table.column("last").combine_chunks()]).unique().sort()
    code = lambda c: pc.index_in(table.column(c), known).to_numpy().astype(np.int64)
    window, at = table.column("window").to_numpy(), table.column("at").to_numpy()
    first, last = code("id"), code("last")
    order = np.lexsort((at, first, window))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(window[order]) != 0)))
    keep = pa.array(order[starts])
    most = pa.array(np.maximum.reduceat(last[order], starts))
    n = pa.array(np.add.reduceat(table.column("n").to_numpy()[order], starts))
    return pa.table([*(table.column(c).take(keep) for c in ("window", "id", "at")), known.take(most), n], names=table.column_names)


def _fold(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of one window are put together as a task meets them, so what many documents hold is handed out once; about ``most`` rows are held."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            table = _folded(pa.Table.from_batches(held))
            if table.num_rows > most // 2:
                yield from table.to_batches()
                held, size = [], 0
            else:
                held, size = table.to_batches(), table.num_rows
    if held:
        yield from _folded(pa.Table.from_batches(held)).to_batches()


def _spots_and_routes(
    ids: pa.Array, row: np.ndarray, hashes: np.ndarray, at: np.ndarray, anchor: np.ndarray, anchor_at: np.ndarray, common: np.ndarray, places: Places
) -> Iterator[pa.RecordBatch]:
    names, here = ["deal", "id", "at", "windows", "source", "chunk"], np.zeros(len(hashes), bool)
    if len(places.hashes):
        found = np.minimum(np.searchsorted(places.hashes, hashes), len(places.hashes) - 1)
        here = places.hashes[found] == hashes
        groups = len(places.sources)
        pairs, part = np.unique(np.stack([row[here] * groups + places.group[found[here]], at[here] // PART]), axis=1)
        doc, group = ids.take(pa.array(pairs // groups)), pa.array(pairs % groups)
        start, none = pa.array((part * PART).astype(np.int32)), pa.array([[None]] * len(pairs), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int32()), doc, start, none, places.sources.take(group), places.chunks.take(group)], names=names)
    row, hashes, at, anchor, anchor_at = row[~here], hashes[~here], at[~here], anchor[~here], anchor_at[~here]
    if not len(row):
        return
    alone = np.isin(anchor, common)
    # The anchor's place is one of the block, so it tells rows apart too.
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor_at) != 0) | (np.diff(at) != 1) | alone[1:])))
    deal = (np.where(alone, hashes, anchor)[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(hashes.view(np.int64)))
    known = [pa.array(deal), ids.take(pa.array(row[first])), pa.array(at[first]), held]
    yield pa.RecordBatch.from_arrays([*known, pa.nulls(len(first), ids.type), pa.nulls(len(first), pa.int32())], names=names)


def occurrences(rows: DataFrame, recurring: np.ndarray, bits: int, common: np.ndarray, places: Places) -> DataFrame:
    """(deal, window, id, at) of windows whose anchor is in the bitmap, or, of common ones, (id, at, source, chunk) once a part, ``at`` being its start.

    Windows that follow one another and have the same anchor are shuffled as one row, dealt by the anchor, since equal windows
    have equal anchors. Those of a common anchor go one by one and are dealt by their hash, so no anchor fills a task.
    """
    runs = _marked(rows, recurring, bits, common, "deal int, id {0}, at int, windows array<long>, source {0}, chunk int", _spots_and_routes, places)
    # Common windows are routed already: their rows are dealt by document.
    dealt = runs.withColumn("deal", F.coalesce("deal", F.hash("id"))).repartition("deal")
    spots = dealt.select("deal", "id", "at", "source", "chunk", F.posexplode("windows").alias("nth", "window"))
    return spots.withColumn("at", F.col("at") + F.col("nth")).withColumn("window", F.coalesce("window", F.xxhash64("id"))).drop("nth")


def common_windows(rows: DataFrame, common: np.ndarray, marks: np.ndarray, bits: int, scratch: Scratch) -> pa.Table:
    """(window, id, at): the first places of the windows that are in most places and in two documents."""
    spots = _marked(rows, marks, bits, common, "window long, id {0}, at int, last {0}, n long", _spots, fold=_fold)
    first = spots.groupBy("window").agg(F.min(F.struct("id", "at")).alias("place"), F.max("last").alias("last"), F.sum("n").alias("n"))
    counted = scratch.write(first, "counted")
    return counted.where(_is_common(counted) & (F.col("place.id") < F.col("last"))).select("window", "place.id", "place.at").toArrow()


def _runs(covered: list[tuple[int, int]]) -> list[int]:
    """Sorted (start, stop) runs merged where they touch, as one flat list."""
    out: list[int] = []
    for start, stop in sorted(covered):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


class Automaton:
    """Passages of the shard's sources, over an alphabet with one character a word.

    A passage is the words of windows of one source that follow one another. Its seeds are the SEED-word
    phrases at every SEED-th word of it, so each of its windows has one whole. The automaton finds the seeds; a seed is
    extended both ways as far as passage and text agree, and what comes to a window or more is covered.
    """

    #: Characters for words from here on, without the surrogates; 0 is for words that no passage has.
    FIRST, GAP, GAP_SIZE = 1, 0xD800, 0x800

    def __init__(self) -> None:
        self.letters: dict[bytes, str] = {}
        self.passages: list[tuple[object, str]] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.ready = False

    def add(self, source: object, words: list[bytes], at: list[int]) -> None:
        """``at`` has the windows' first words in order."""
        letters = self.letters
        bounds = _runs([(a, a + 1) for a in at])
        for start, after in zip(bounds[::2], bounds[1::2], strict=True):
            held = words[start : after + WINDOW - 1]
            for w in held:
                if w not in letters:
                    code = self.FIRST + len(letters)
                    letters[w] = chr(code + self.GAP_SIZE * (code >= self.GAP))
            passage = "".join([letters[w] for w in held])
            for offset in range(0, len(passage) - SEED + 1, SEED):
                seed, here = passage[offset : offset + SEED], (len(self.passages), offset)
                if (known := self.machine.get(seed, None)) is None:
                    self.machine.add_word(seed, [here])
                else:
                    known.append(here)
            self.passages.append((source, passage))

    def covered(self, target: object, words: list[bytes]) -> list[int]:
        """Runs of words in windows that a source smaller than the target holds."""
        if not self.letters:
            return []
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        get = self.letters.get
        text = "".join([get(w, "\0") for w in words])
        found: list[tuple[int, int]] = []
        # Where the last extension ended, by passage and place of its first word: seeds before that were part of it.
        done: dict[tuple[int, int], int] = {}
        for end, seeds in self.machine.iter(text):
            at = end + 1 - SEED
            for number, offset in seeds:
                source, passage = self.passages[number]
                first = at - offset
                if not source < target or done.get((number, first), -1) > at:
                    continue
                a, b = at, end + 1
                low, high = max(0, first), min(len(text), first + len(passage))
                while a > low and text[a - 1] == passage[a - 1 - first]:
                    a -= 1
                while b < high and text[b] == passage[b - first]:
                    b += 1
                done[number, first] = b
                if b - a >= WINDOW:
                    found.append((a, b))
        return _runs(found)


def parts_of(texts: DataFrame, most: int = 4 << 20) -> DataFrame:
    """(id, key, shard, salt, start, places, text) of the parts that the ``wants`` (shard, salt, part, places) of each text name."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            rows, cut, size = [], [], 0
            for i, (words, wants) in enumerate(zip(_words(batch.column("text")), batch.column("wants").to_pylist(), strict=True)):
                for want in wants:
                    start = want["part"] * PART
                    # An id's other rows, if it is repeated, may be shorter.
                    if len(held := words[start : start + PART + WINDOW - 1]) >= WINDOW:
                        rows.append(i)
                        cut.append((want["shard"], want["salt"], start, want["places"], b" ".join(held)))
                        size += len(cut[-1][-1])
                    if size > most:
                        yield packed(batch, rows, cut)
                        rows, cut, size = [], [], 0
            yield packed(batch, rows, cut)

    def packed(batch: pa.RecordBatch, rows: list[int], cut: list[tuple]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        made = [pa.array([x[i] for x in cut], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), *made], names=["id", "key", "shard", "salt", "start", "places", "text"])

    schema = texts.select("id", "key").schema.add("shard", "integer").add("salt", "integer").add("start", "integer")
    schema = schema.add("places", T.ArrayType(T.IntegerType())).add("text", "binary")
    return texts.select("id", "key", "text", "wants").mapInArrow(trimmed(make), schema)


def matched(routed: DataFrame) -> DataFrame:
    """(id, key, runs) from rows (shard, salt, id, key, start, places, text), sources before targets in each (shard, salt)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine = None, Automaton()
        for batch in batches:
            ids, keys, runs = [], [], []
            columns = (batch.column(c) for c in ("shard", "salt", "id", "key", "start", "places", "text"))
            for shard, salt, doc, key, start, places, text in zip(*columns, strict=True):
                if (shard.as_py(), salt.as_py()) != current:
                    current, machine = (shard.as_py(), salt.as_py()), Automaton()
                words, start = (text.as_py() or b"").split(), start.as_py()
                if places.is_valid:
                    machine.add(doc.as_py(), words, [p - start for p in places.as_py() if p - start + WINDOW <= len(words)])
                elif found := machine.covered(doc.as_py(), words):
                    ids.append(doc.as_py())
                    keys.append(key.as_py())
                    runs.append([start + x for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(keys, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["id", "key", "runs"])

    return routed.mapInArrow(trimmed(make), routed.select("id", "key").schema.add("runs", T.ArrayType(T.IntegerType())))


def find_runs(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, windows_per_shard: int = 32_768, parts_per_task: int = 8_192) -> tuple[DataFrame, DataFrame]:
    """What to remove: (id, key, n_words, digest, copy) of every row, and (id, key, runs) of rows with covered words.

    ``copy`` rows have the words of a smaller document and lose them all; runs that they may have (if their id is repeated) don't count.
    """
    rows = _rows(docs, id_col, text_col)
    found = scratch.write(profiles(rows), "profiles")
    firsts = scratch.write(found.where("id is not null").groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first")), "firsts")
    copy = (F.col("first") < F.col("id")) & (F.col("n_words") >= WINDOW)
    known = scratch.write(
        found.join(firsts, F.col("digest") == F.col("of"), "left").select("id", "key", "n_words", "digest", F.coalesce(copy, F.lit(False)).alias("copy")), "known"
    )
    scratch.drop("profiles", "firsts")

    spread = anchors(rows).groupBy("phrase").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count(F.lit(1)).alias("n"))
    recurring = scratch.write(spread.where("a <> b").select("phrase", "n"), "recurring")
    marks, bits = bitmap(recurring, "phrase", recurring.count(), MAX_BITMAP_BITS)
    table = marks.toArrow()
    array = np.zeros(1 << max(0, bits - 6), np.uint64)
    array[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)

    many = common_anchors(recurring)
    scratch.drop("recurring")
    common = common_windows(rows, many, array, bits, scratch)
    scratch.drop("counted")
    table = docs.sparkSession.createDataFrame(common.select(["id", "at"]), T.StructType([rows.schema["id"], T.StructField("at", T.IntegerType())]))
    spots = occurrences(rows, array, bits, many, Places(common))
    by, chunk = W.Window.partitionBy("deal", "window"), F.floor(F.col("at") / CHUNK).cast("int")
    spots = spots.withColumn("place", F.min(F.when(F.col("source").isNull(), F.struct("id", "at"))).over(by)).withColumn("last", F.max("id").over(by))
    routed = F.col("source").isNotNull()
    is_source = (F.col("id") == F.col("place.id")) & (F.col("at") == F.col("place.at"))
    first = F.coalesce("source", "place.id")
    wanted = F.when(routed, F.col("id") > F.col("source")).otherwise((F.col("place.id") < F.col("last")) & (is_source | (F.col("id") > F.col("place.id"))))
    at_first = F.coalesce("chunk", F.floor(F.col("place.at") / CHUNK).cast("int"))
    part = F.floor(F.col("at") / PART).cast("int").alias("part")
    found = spots.where(wanted).select("id", first.alias("source"), at_first.alias("chunk"), part, F.when(~routed & is_source, F.col("at")).alias("place"))
    shared = scratch.write(found.unionAll(table.select("id", F.col("id").alias("source"), chunk.alias("chunk"), part, F.col("at").alias("place"))).distinct(), "shared")
    sources = shared.where("place is not null")
    shards = max(1, ceil(sources.count() / windows_per_shard))
    shard = F.pmod(F.xxhash64("source", "chunk"), F.lit(shards)).cast("int").alias("shard")
    patterns = sources.select("id", shard, "part", "place").groupBy("id", "shard", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))
    # Copies of an earlier text are cut whole anyway; an id's other rows, if it is repeated, are not.
    whole = known.groupBy(F.col("id").alias("gone")).agg(F.every("copy").alias("copies")).where("copies").select("gone")
    targets = shared.where("place is null").select("id", shard, "part").distinct().join(whole, F.col("id") == F.col("gone"), "left_anti")
    targets = scratch.write(targets, "targets")
    salts = targets.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / parts_per_task).cast("int").alias("salts"))
    # One row a shard, and shards hold thousands of windows each; still, the join is left to Spark.
    aimed = targets.join(salts, "shard").select("id", "shard", F.pmod(F.xxhash64("id", "part"), F.col("salts")).cast("int").alias("salt"), "part", F.lit(None).cast("array<int>").alias("places"))
    # A source goes to all salts of its shard, up to the one named here.
    spread_sources = patterns.join(salts, "shard").select("id", "shard", (F.col("salts") - 1).alias("salt"), "part", "places")
    wanted = scratch.write(aimed.unionAll(spread_sources), "wanted")
    scratch.drop("shared", "targets")

    texts = maybe_among(rows, "id", wanted.select("id").distinct(), scratch, "wanted_ids").where("__maybe").drop("__maybe")
    # A window has one source, so a document has no more of these than windows.
    wants = wanted.groupBy("id").agg(F.collect_list(F.struct("shard", "salt", "part", "places")).alias("wants"))
    cut = parts_of(texts.join(wants, "id"))
    salt = F.explode(F.when(F.col("places").isNull(), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("salt")))).alias("salt")
    routed = cut.select("shard", salt, "id", "key", "start", "places", "text").repartition(max(partitions(docs.sparkSession), 2 * shards), "shard", "salt")
    runs = scratch.write(matched(routed.sortWithinPartitions("shard", "salt", F.col("places").isNull())), "runs")
    merged = runs.groupBy("id", "key").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    return known, scratch.write(merged, "merged")


def removed(known: DataFrame, runs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row; only texts with covered words are read again."""
    cut_rows = runs.join(known.where("copy").select(F.col("id").alias("i"), F.col("key").alias("k")).distinct(), (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")), "left_anti")
    cut_rows = scratch.write(cut_rows, "cut_rows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, runs in zip(_words(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                spans = _runs(list(zip(runs[::2], runs[1::2], strict=True)))
                kept, at = [], 0
                for start, stop in zip(spans[::2], spans[1::2], strict=True):
                    kept += words[at:start]
                    at = stop
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_words", "n_removed", "kept_sha256"])

    texts = maybe_among(rows, "id", cut_rows.select("id").distinct(), scratch, "cut_ids").where("__maybe")
    joined = texts.join(cut_rows, ["id", "key"]).select("id", "runs", "text")
    cut_out = joined.mapInArrow(trimmed(cut), joined.select("id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string"))
    marked = cut_rows.select(F.col("id").alias("i"), F.col("key").alias("k"))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = known.join(marked, (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")), "left_anti").select(
        "id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
    return whole.unionAll(cut_out)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: str, runs: list[int]) -> str:
    """The text without the words of the runs and the white space that follows them."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(data)]
    kept, at = [], 0
    merged = _runs(list(zip(runs[::2], runs[1::2], strict=True)))
    for start, stop in zip(merged[::2], merged[1::2], strict=True):
        kept.append(data[at : spans[start][0]])
        at = spans[stop][0] if stop < len(spans) else len(data)
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words cut out of the texts; documents that lose all their words go.

    Texts that lose nothing stay as they are and aren't shuffled.
    """
    scratch, search = Scratch(docs.sparkSession, "substrings"), Scratch(docs.sparkSession, "substrings-search")
    known, runs = find_runs(docs, search, id_col, text_col)
    copies = known.where("copy").select("id", "key").distinct().withColumn("copy", F.lit(True))
    losses = scratch.write(
        copies.join(runs, ["id", "key"], "full").select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.coalesce("copy", F.lit(False)).alias("__copy"), F.col("runs").alias("__runs")),
        "losses",
    )
    search.clear()
    flagged = maybe_among(docs, id_col, losses.select(F.col("__id").alias("id")).distinct(), scratch, "loss_ids")

    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            runs = batch.column(batch.num_columns - 1).to_pylist()
            texts = [x.as_py() if r is None or not x.is_valid else cut_text(x.as_py(), r) for x, r in zip(batch.column(place), runs, strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, columns[place].type)
            # Rows that the bitmap let through for nothing keep their texts; cut ones need a word that is left.
            left = [r is None or t is None or bool(WORD.search(t.encode("utf-8", "surrogatepass"))) for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(left, pa.bool_()))

    key = F.xxhash64(F.col(text_col).cast("binary"))
    touched = flagged.where("__maybe").join(losses, (F.col(id_col) == F.col("__id")) & (key == F.col("__key")), "left").where("not coalesce(__copy, false)")
    shorter = touched.select(*docs.columns, "__runs").mapInArrow(trimmed(cut), docs.schema)
    return flagged.where("not __maybe").select(*docs.columns).unionAll(shorter)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses, and a digest of what it keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "substrings")
    known, runs = find_runs(docs, scratch, "doc_id", "text")
    return removed(known, runs, _rows(docs, "doc_id", "text"), scratch).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that earlier ones hold, ``n_chars`` counted anew."""
    cut = cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), wins AS (
  SELECT doc_id, words, i AS spot, words[i:i + 12] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)
), firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win)
, covered AS (
  SELECT doc_id, list_distinct(flatten(list(range(spot, spot + 13)))) AS gone
  FROM wins JOIN firsts USING (win) WHERE first < doc_id GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(
         list_filter(words, lambda w, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM split LEFT JOIN covered USING (doc_id)
"""
