"""Operator 9, token counts: documents found in flat, unindexed token files by their separators.

``write_flat`` tokenises documents into flat files of little-endian ids, each document closed by the
end-of-document id. A file's last document is its roster: the ids of its documents as digits, written by the
same task as the documents themselves, so that counts can be put against ids. Nothing says where a document starts.

``scan_flat`` lists files and lengths only and deals out blocks of fixed length, so a file is read by as many tasks as it has blocks, each
reading its own range. A block is searched with a vectorised comparison: it gives the separators
in the block, the tokens before the first, after the last and between them. A prefix scan over a file's
blocks (running sum of separators, running maximum of the last separator's place) stitches the documents
that blocks cut, however many blocks they span. Ranges are read with Arrow's file systems. A store that they don't know
is read by Spark: files of up to ``WHOLE`` bytes whole, larger ones of any size as Hadoop's records of one length, which has to divide the
file's; if only short ones do, records are many and small, and that is slow.

Defined cases: null and empty texts have 0 tokens. The text of an end-of-document token in a document
is ordinary text. Repeated rows are counted one by one, and null ids stay null. A file that doesn't end with a
separator, as when it is cut off or has none, raises an error, and so does a roster that doesn't fit the documents. So does a
vocabulary whose ids don't fit the width or hold the end-of-document id. An empty table gives no
documents. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import Scratch, partitions, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary above splits texts before merging. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
#: Tokens in a block of the scan.
BLOCK = 1 << 20
KINDS = {2: "<u2", 4: "<u4"}
#: Bytes of a file that one task may hold where ranges can't be read.
WHOLE = 64 << 20
#: Hadoop's names of stores that Arrow knows by another one. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Base-32768 digits of an id in the roster; the last one also tells a null.
DIGITS, DIGIT_BITS = 5, 15
NULL_BIT = 1 << (DIGIT_BITS - 1)


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _offset(end: int) -> int:
    """Added to digits so that none is the end-of-document id."""
    return 0 if end >= 1 << DIGIT_BITS else end + 1


def roster_digits(ids: list[int | None], end: int) -> np.ndarray:
    """The ids as digits, lowest first, and then their count."""
    return np.concatenate([digits_of(ids, end), digits_of([len(ids)], end)])


def digits_of(ids: list[int | None], end: int) -> np.ndarray:
    values = np.array([(x or 0) & ((1 << 64) - 1) for x in ids], np.uint64)
    digits = (values[:, None] >> np.arange(0, DIGITS * DIGIT_BITS, DIGIT_BITS, dtype=np.uint64)) & np.uint64((1 << DIGIT_BITS) - 1)
    digits[[i for i, x in enumerate(ids) if x is None], -1] |= np.uint64(NULL_BIT)
    return digits.ravel() + np.uint64(_offset(end))


def roster_ids(digits: np.ndarray, end: int) -> list[int | None]:
    parts = (digits.astype(np.uint64) - np.uint64(_offset(end))).reshape(-1, DIGITS)
    missing = (parts[:, -1] & np.uint64(NULL_BIT)) != 0
    values = (parts << np.arange(0, DIGITS * DIGIT_BITS, DIGIT_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    return [None if gone else int(x) for x, gone in zip(values, missing, strict=True)]


def write_flat(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, end: int = END_OF_DOCUMENT, width: int = 2
) -> None:
    """Write one flat file of ``width``-byte ids for each partition of ``docs``.

    Spark's text writer puts the line separator, here the bytes of the end-of-document id, after each
    row and writes the bytes of a string as they are.
    """
    with open(ranks, "rb") as f:
        content = f.read()
    ids = {int(line.split()[1]) for line in content.splitlines()}
    if max(ids, default=0) >> 8 * width or end >> 8 * width or end in ids:
        raise ValueError(f"ids up to {max(ids)} and the end-of-document id {end} can't be told apart in {width} bytes")
    shared, kind = docs.sparkSession.sparkContext.broadcast(content), KINDS[width]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, rows = encoding(shared.value, pattern).encode_to_numpy, [], 0
        for batch in slices(batches, 1):
            seen.append(digits_of(batch.column(0).to_pylist(), end).astype(kind))
            rows += batch.num_rows
            out = [encode(x.as_py() or "", disallowed_special=()).astype(kind).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if rows:
            roster = np.concatenate([*seen, digits_of([rows], end).astype(kind)])
            yield pa.RecordBatch.from_arrays([pa.array([roster.tobytes()], pa.binary())], names=["value"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tokens, "value binary")
    separator = end.to_bytes(width, "little").decode("latin-1")
    rows.select(F.col("value").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _system(file: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a file that Spark listed, and the file's path there."""
    scheme, colon, rest = file.partition(":")
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def _reachable(file: str) -> bool:
    try:
        system, path = _system(file)
        return system.get_file_info(path).type == pyarrow.fs.FileType.File
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(file, length) of the files below ``path``, with ``content`` where tasks can't read ranges themselves; and whether they can."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").withColumnRenamed("path", "file")
    first = files.select("file").first()
    ranged = first is None or _reachable(first["file"])
    return files.select("file", "length", *([] if ranged else ["content"])), ranged


def _large(files: DataFrame, ranged: bool) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The files that are read by ranges or whole, and (file, length) of those too large to be read whole."""
    if ranged:
        return files, []
    large = files.where(F.col("length") > WHOLE).select("file", "length").collect()
    return files.where(F.col("length") <= WHOLE), [(x["file"], x["length"]) for x in large]


def _record_bytes(length: int, width: int, most: int) -> int:
    """The most bytes, of whole tokens and up to ``most``, that divide the length of a file."""
    sizes = np.arange(1, min(most, length) // width + 1) * width
    return int(sizes[length % sizes == 0].max())


def _stretches(spark: SparkSession, file: str, length: int, width: int, most: int) -> DataFrame:
    """(file, length, at, content): a file in stretches of about ``most`` bytes, read as records of one length through Hadoop."""
    record = _record_bytes(length, width, most)

    def join(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, int, int, bytearray]]:
        held, start = bytearray(), 0
        for at, content in records:
            if held and len(held) + len(content) > most:
                yield file, length, start, held
                held = bytearray()
            start = start if held else at
            held += content
        if held:
            yield file, length, start, held

    hadoop = "org.apache.hadoop"
    conf = {"fixedlengthinputformat.record.length": str(record)}
    records = spark.sparkContext.newAPIHadoopFile(file, f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable", conf=conf)
    return spark.createDataFrame(records.mapPartitions(join), "file string, length long, at long, content binary")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, Callable[[int, int], pa.Buffer]]]:
    """(row, file, length, function that reads so many bytes from a place on) of each row."""
    files, lengths = batch.column("file").to_pylist(), batch.column("length").to_pylist()
    for n, (file, length) in enumerate(zip(files, lengths, strict=True)):
        if "content" in batch.schema.names:
            content = batch.column("content")[n].as_buffer()
            yield n, file, length, lambda at, size, content=content: content.slice(at, size)
        else:
            system, path = _system(file)
            with system.open_input_file(path) as opened:
                yield n, file, length, lambda at, size, opened=opened: opened.read_buffer(size) if opened.seek(at) is not None else None


def scan_flat(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, last) of all documents in the flat files below ``path``."""
    kind, step = KINDS[width], block * width
    files, ranged = _files(spark, path)
    files, large = _large(files, ranged)
    for file, length in large:
        if length % width:
            raise ValueError(f"{file} does not end with a separator: it ends within a token")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, file, length, read in _opened(batch):
                for place in [batch.column("at")[n].as_py()] if ranged else range(0, length, step):
                    size = min(step, length - place)
                    if size % width:
                        raise ValueError(f"{file} does not end with a separator: it ends within a token")
                    yield searched(file, place, read(place, size))

    def searched(file: str, place: int, content: pa.Buffer) -> pa.RecordBatch:
        ids = np.frombuffer(content, kind)
        at = np.flatnonzero(ids == end)
        head, final = (int(at[0]), int(at[-1])) if len(at) else (None, None)
        row = (file, place // width, len(at), len(ids), head, final, (np.diff(at) - 1).tolist())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    def search_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, place, content in zip(*(batch.column(c) for c in ("file", "at", "content")), strict=True):
                yield searched(file.as_py(), place.as_py(), content.as_buffer())

    names = ["file", "start", "n", "size", "head", "final", "gaps"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    if ranged:
        places = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))
        files = files.select("file", "length", F.explode(places).alias("at")).repartition(partitions(spark), "file", "at")
    schema = "file string, start long, n long, size long, head long, final long, gaps array<long>"
    found = files.mapInArrow(search, schema)
    for file, length in large:
        found = found.unionAll(_stretches(spark, file, length, width, step).mapInArrow(search_stretches, schema))
    # The prefix scan needs the blocks' sums only: gaps stay out of it.
    found = Scratch(spark, "scan").write(found, "blocks")
    start = F.col("start")
    ends = found.groupBy("file").agg((F.max(start + F.col("size")) - 1).alias("stop"), F.coalesce(F.max(start + F.col("final")), F.lit(-1)).alias("closed"))
    if cut := ends.where("stop <> closed").select("file").first():
        raise ValueError(f"{cut['file']} does not end with a separator")
    before = W.Window.partitionBy("file").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)
    every = W.Window.partitionBy("file")
    stitched = (
        found.drop("gaps")
        .withColumn("documents_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("carried", start - 1 - F.coalesce(F.max(start + F.col("final")).over(before), F.lit(-1)))
        .withColumn("documents", F.sum("n").over(every))
        .where("n > 0")
        .select("file", "start", "documents_before", "documents", (F.col("head") + F.col("carried")).alias("first"))
    )
    lengths = F.concat(F.array("first"), F.col("gaps"))
    whole = stitched.join(found.where("n > 0").select("file", "start", "gaps"), ["file", "start"])
    return whole.select("file", "documents_before", "documents", F.posexplode(lengths).alias("k", "n_tokens")).select(
        "file",
        (F.col("documents_before") + F.col("k")).alias("ordinal"),
        "n_tokens",
        (F.col("documents_before") + F.col("k") == F.col("documents") - 1).alias("last"),
    )


def _listed(file: str, length: int, end: int, width: int, tail: bytes) -> int:
    """How many ids a roster has, by the digits before the file's last separator."""
    stop = length - width - DIGITS * width
    listed = roster_ids(np.frombuffer(tail, KINDS[width]), end)[0] if stop >= 0 else -1
    if listed is None or not 0 <= listed <= stop // (DIGITS * width):
        raise ValueError(f"{file}: its roster does not fit")
    return listed


def _large_roster(spark: SparkSession, file: str, length: int, id_col: str, end: int, width: int, block: int) -> DataFrame:
    """The roster of a file that is read as records: one task joins the stretches that the roster is in."""
    size = DIGITS * width
    stop = length - width - size
    last = F.col("at") + F.octet_length("content")

    stretches = _stretches(spark, file, length, width, block * width)
    ends = stretches.where(last > stop).orderBy("at").collect()
    listed = _listed(file, length, end, width, b"".join(bytes(x["content"]) for x in ends)[-width - size :][:size])
    start = stop - listed * size

    def ids(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        content = b"".join(map(bytes, frame["content"]))[start - int(frame["at"].iloc[0]) :][: listed * size]
        found = roster_ids(np.frombuffer(content, KINDS[width]), end)
        return pd.DataFrame({"file": file, "ordinal": range(listed), id_col: pd.array(found, "Int64"), "listed": listed})

    return stretches.where((last > start) & (F.col("at") < stop)).groupBy("file").applyInPandas(ids, f"file string, ordinal long, `{id_col}` long, listed long")


def read_rosters(spark: SparkSession, path: str, id_col: str, end: int = END_OF_DOCUMENT, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, id, listed) from the rosters, which are found from the files' ends."""
    kind, size = KINDS[width], DIGITS * width
    files, large = _large(*_files(spark, path))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, file, length, read in _opened(batch):
                stop = length - width - size
                listed = _listed(file, length, end, width, read(stop, size) if stop >= 0 else b"")
                for at in range(0, listed, block):
                    n = min(block, listed - at)
                    found = roster_ids(np.frombuffer(read(stop - (listed - at) * size, n * size), kind), end)
                    columns = [pa.array([file] * n), pa.array(range(at, at + n), pa.int64()), pa.array(found, pa.int64()), pa.array([listed] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", id_col, "listed"])

    found = files.repartition(partitions(spark), "file").mapInArrow(ids, f"file string, ordinal long, `{id_col}` long, listed long")
    for file, length in large:
        found = found.unionAll(_large_roster(spark, file, length, id_col, end, width, block))
    return found


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The id and ``n_tokens`` of every document, found by scanning the flat files that it is written to."""
    spark = docs.sparkSession
    path = Scratch(spark, "separators").path("flat")
    write_flat(docs, path, id_col, text_col, **settings)
    layout = {k: v for k, v in settings.items() if k in ("end", "width")}
    counts = scan_flat(spark, path, **layout).where("not last")
    rosters = read_rosters(spark, path, id_col, **layout)
    both = counts.join(rosters, ["file", "ordinal"], "full")
    fits = F.expr(f"if(n_tokens is null or listed is null, raise_error(concat(file, ': its roster does not fit')), true)")
    return both.where(fits).select(id_col, "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
