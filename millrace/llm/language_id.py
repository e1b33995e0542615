"""Operator 1, language ID: the language whose dictionary compresses a text best.

Learning: a bounded sample of labelled rows (at most ``sample_rows`` slices of ``slice_chars`` characters a
language, and about ``all_rows`` slices of all languages, but one of each at least) gives each language a raw-content zstandard
dictionary of at most ``dictionary_bytes``. Rows are drawn by a hash of id and text, the least hashes of each language.
Predicting: a text is lower-cased, runs of other than letters and their marks become one space, and its UTF-8
bytes are compressed in blocks of ``block_bytes`` against each dictionary; the sums of the compressed
sizes over all blocks are compared. Blocks keep a dictionary's effect the same from the
first to the last word of a long text. Compressed sizes are whole bytes, so where the best two sums differ by CLOSE bytes or fewer,
a text is measured more finely: CUTS leading parts of its first block are compressed as well, and sums of all sizes are compared.
``score`` is the share by which the best sum is below the second best; a prediction is ``accepted`` if that
margin is at least ``min_margin``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted. Equal
sums go to the language with more labelled rows, then to the lower name, with score 0. Null languages teach
nothing. A language whose sample has no letter has an empty dictionary (spaces) and still takes part. With one language
only, every text with a letter is of it, with score 1. With no labelled row at
all, every text is ``und``. Null ids are predicted like others but teach nothing. Repeated rows are
predicted one by one, and other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import trimmed

LETTER = regex.compile(r"\p{L}")
#: What is neither letter nor mark: in ASCII, and in general.
OTHER_ASCII, OTHER = re.compile(r"[^a-z]+"), regex.compile(r"[^\p{L}\p{M}]+")
#: Bytes of difference from which sums tell languages apart without a finer look, and parts of a text in such a look.
CLOSE, CUTS = 2, 8
#: Rows that are looked at for a sample, in rows of the sample.
OVERDRAW = 4
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and sizes of the encoder."""

    sample_rows: int = 256
    all_rows: int = 51_200
    slice_chars: int = 1024
    dictionary_bytes: int = 131_072
    block_bytes: int = 4096
    level: int = 3
    min_margin: float = 0.01


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normal(text: str) -> bytes:
    low = text.lower()
    return (OTHER_ASCII if low.isascii() else OTHER).sub(" ", low).strip().encode("utf-8", "replace")


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, settings: Settings) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with most labelled rows first."""
    key, text, lang = F.col(id_col), F.col(text_col), F.col(lang_col)
    usable = docs.where(~held_out(key) & key.isNotNull() & lang.isNotNull() & text.isNotNull())
    counts = sorted(usable.groupBy(lang.alias("lang")).count().collect(), key=lambda r: (-r["count"], r["lang"]))
    if not counts:
        return []
    rows = max(1, min(settings.sample_rows, settings.all_rows // len(counts)))
    at = F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.lit(1), F.length(text) - settings.slice_chars + 1)).cast("int") + 1
    order = F.shiftrightunsigned(F.xxhash64(key, text), 1)
    parts = usable.select(lang.alias("lang"), order.alias("order"), F.substring(text, at, F.lit(settings.slice_chars)).alias("part"))

    def least(limits: list[tuple[str, int]]) -> dict[str, list[bytes]]:
        """The slices of the least hashes of these languages, among hashes up to a limit each."""
        known = F.broadcast(docs.sparkSession.createDataFrame(limits, "of string, most long"))
        rank = F.row_number().over(W.Window.partitionBy("lang").orderBy("order", "part"))
        drawn = parts.join(known, (F.col("lang") == F.col("of")) & (F.col("order") <= F.col("most"))).withColumn("n", rank)
        out: dict[str, list[bytes]] = {}
        for row in drawn.where(F.col("n") <= rows).select("lang", "n", "part").orderBy("lang", "n").collect():
            out.setdefault(row["lang"], []).append(normal(row["part"]))
        return out

    # Hashes are spread evenly, so the sample of a language is among so many of the least; most rows are never shuffled.
    # Where rows repeat they may not be: such languages are drawn again from all their rows.
    top = (1 << 63) - 1
    found = least([(r["lang"], min(top, OVERDRAW * rows * top // r["count"])) for r in counts])
    if short := [(r["lang"], top) for r in counts if len(found.get(r["lang"], [])) < min(rows, r["count"])]:
        found |= least(short)
    # A dictionary has eight bytes at least.
    return [(r["lang"], b" ".join(x for x in found[r["lang"]] if x)[: settings.dictionary_bytes].rjust(8)) for r in counts]


class Encoder:
    """Compressors of one worker, one a language."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], settings: Settings):
        self.settings = settings
        self.names = [name for name, _ in dictionaries]
        self.compressors = []
        for _, content in dictionaries:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=settings.level)
            self.compressors.append(
                zstandard.ZstdCompressor(level=settings.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0
        data = normal(text)
        step = self.settings.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        if len(sizes) == 1:
            return self.names[0], 1.0
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if sizes[order[1]] - sizes[order[0]] <= CLOSE:
            parts = [blocks[0][: -(-len(blocks[0]) * i // CUTS)] for i in range(1, CUTS)]
            sizes = [size + sum(len(c.compress(p)) for p in parts) for size, c in zip(sizes, self.compressors, strict=True)]
            order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], (second - best) / second if second else 0.0


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings(), keep: list[str] | None = None
) -> DataFrame:
    """Predict every row's language from its whole text.

    Returns the id, ``held_out``, ``lang_pred``, ``score`` and ``accepted``; with ``keep`` those
    columns of ``docs`` too, as ``keep`` (a struct).
    """
    spark = docs.sparkSession
    dictionaries = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, settings))
    # A text that is kept is sent once.
    inside = keep.index(text_col) if keep and text_col in keep else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries.value, settings)
        for batch in batches:
            texts = batch.column("__text") if inside is None else batch.column("keep").field(inside)
            got = [encoder.predict(x.as_py()) for x in texts]
            names = [n for n in batch.schema.names if n != "__text"]
            langs, scores = pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), langs, scores], names=[*names, "lang_pred", "score"])

    kept = [F.struct(*keep).alias("keep")] if keep else []
    text = [F.col(text_col).alias("__text")] if inside is None else []
    rows = docs.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("held_out"), *kept, *text)
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    accepted = (F.col("score") >= settings.min_margin) & (F.col("lang_pred") != UNDETERMINED)
    return rows.mapInArrow(trimmed(predict), schema).withColumnRenamed("__id", id_col).withColumn("accepted", accepted)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin, with their own columns."""
    columns = docs.columns
    return identify(docs, keep=columns).where("accepted").select(*(F.col("keep").getField(c).alias(c) for c in columns))
