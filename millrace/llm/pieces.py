"""Operator 7, SentencePiece encoding and decoding by a forward pass over a trie of marked words.

A text gets the leading mark and marks for its spaces, and is cut into marked words: marks, then characters of
the vocabulary; a character that the vocabulary lacks is a word of its own. No piece
reaches over such a cut, so words are encoded alone. Per block of documents the distinct words are sorted, which
lines them up as a depth-first walk of their trie (those of earlier blocks are known already); the forward states of a word are kept as far as the next word
shares its prefix and computed only for what is new.

The forward state of a prefix is its best segmentation's last piece. With a unigram model it is Viterbi's best
score, kept for every prefix. The vocabulary given here is a BPE model, whose result is not the segmentation of the best
summed score, so there the state is the one last piece under which merging stops at exactly these
pieces, kept for the prefixes that had to be looked at: two neighbours are allowed if merging their joined text gives back the two, and a segmentation in
which all neighbours are allowed is the merged one. It depends on the prefix only, like a score.

Defined cases: a null text has null ids; an empty one has none. Characters outside the vocabulary become bytes if the
model has byte pieces, else the unknown piece. A text that holds the mark itself decodes to spaces there
(``round_trip`` is false). Rows are encoded one by one, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import slices, trimmed

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text that a task encodes at a time.
BLOCK_CHARS = 500_000
#: Words whose ids, and pairs of pieces whose verdicts, a task keeps from block to block; then it starts anew.
KEPT_WORDS, KEPT_PAIRS = 250_000, 250_000
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class Codec:
    """One model's pieces, and encoding and decoding with them."""

    def __init__(self, model: bytes):
        spec = dict(_fields(model))
        trainer, normalizer = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep texts as they are, but for marked spaces, are known here")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self._setup(
            pieces={sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain},
            byte_ids={int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)},
            unknown=sp.unk_id(),
            kind=trainer.get(3, UNIGRAM),
            prefix=bool(normalizer.get(3, 1)),
        )

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], kind: int, byte_ids: dict[int, int] | None = None, unknown: int = 0) -> Codec:
        """A codec for a table of pieces: (id, score) by piece."""
        codec = cls.__new__(cls)
        codec._setup(pieces, byte_ids or {}, unknown, kind, True)
        return codec

    def _setup(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], unknown: int, kind: int, prefix: bool) -> None:
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is not known here")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches over a mark")
        self.pieces, self.bytes, self.unknown, self.kind, self.prefix = pieces, byte_ids, unknown, kind, prefix
        known = re.escape("".join(sorted({c for p in pieces for c in p} - {MARK}))) or "\\Z"
        self.words = re.compile(f"{MARK}*[{known}]+|{MARK}+|.", re.DOTALL)
        # Pieces by their characters from the last to the first; under "" a node has (size, piece) of all that end so, the longest first.
        self.ends: dict = {"": ()}
        for piece in sorted(pieces, key=len):
            node, whole = self.ends, ()
            for c in reversed(piece):
                node = node.setdefault(c, {"": whole})
                whole = node[""]
            node[""] = ((len(piece), piece), *whole)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - 10
        self.allowed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        #: Words of those known whose ids don't give back their characters.
        self.lossy: set[str] = set()
        self.out = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()}
        self.out |= {i: bytes([b]) for b, i in byte_ids.items()} | {unknown: " ⁇ ".encode()}

    def merged(self, text: str) -> list[str]:
        """BPE as defined: join the best pair, the first one of equals, until no pair makes a piece."""
        parts, pieces = list(text), self.pieces
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, a: str, b: str) -> bool:
        """Whether merging keeps a and b apart and whole; a is empty at a word's start."""
        found = self.allowed.get((a, b))
        if found is None:
            if len(self.allowed) > KEPT_PAIRS:
                self.allowed.clear()
            found = self.allowed[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def _ending(self, word: str, j: int) -> tuple[tuple[int, str], ...]:
        """(size, piece) of the pieces that end after j characters, the longest first."""
        node, i = self.ends, j
        while i:
            i -= 1
            further = node.get(word[i])
            if further is None:
                break
            node = further
        return node[""]

    def _scores(self, word: str, states: list[tuple[float, str]]) -> None:
        """Unigram: the state after each character that has none yet, (score, last piece)."""
        for j in range(len(states), len(word) + 1):
            best = None
            for size, piece in reversed(self._ending(word, j)):
                score = states[j - size][0] + self.pieces[piece][1]
                if best is None or score > best[0]:
                    best = (score, piece)
            states.append(best or (states[j - 1][0] + self.worst, word[j - 1]))

    def _lasts(self, word: str, states: list[str | None]) -> None:
        """BPE: the last piece of the whole word, and of the prefixes that it takes to tell.

        Just one candidate is allowed, so the order of trying is free: long ones first, which leave few prefixes to look at.
        """
        known = self.allowed
        states += [None] * (len(word) + 1 - len(states))
        todo = [[len(word), self._ending(word, len(word)), 0]] if word else []
        while todo:
            j, candidates, k = todo[-1]
            for size, piece in candidates[k:]:
                last = states[j - size]
                if last is None:
                    break
                fits = known.get((last, piece))
                if self._allowed(last, piece) if fits is None else fits:
                    states[j] = piece
                    break
                k += 1
            else:
                size, last = 1, states[j - 1]
                if last is not None:
                    states[j] = word[j - 1]
            if last is None:
                todo[-1][2] = k
                todo.append([j - size, self._ending(word, j - size), 0])
            else:
                todo.pop()

    def _ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        return [self.bytes[b] for b in piece.encode()] if len(self.bytes) == 256 else [self.unknown]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each word. Sorted words follow the trie depth-first; states are reused up to the shared prefix."""
        found, pieces, bpe = {}, self.pieces, self.kind == BPE
        before, states = "", [""] if bpe else [(0.0, "")]
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            if bpe:
                self._lasts(word, states)
            else:
                self._scores(word, states)
            ids, j = [], len(word)
            while j:
                piece = states[j] if bpe else states[j][1]
                known = pieces.get(piece)
                if known:
                    ids.append(known[0])
                else:
                    ids += reversed(self._ids(piece))
                j -= len(piece)
            ids.reverse()
            found[word] = ids
            before = word
        return found

    def split(self, text: str) -> list[str]:
        return self.words.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end (the first entry is 0)."""
        return self.encode_checked(texts)[:2]

    def encode_checked(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and whether decoding gives each text back. Texts decode word by word, so distinct words are decoded for that."""
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        codes, ends = [], [0]
        for text in texts:
            codes.extend(map(index.__getitem__, self.split(text or "")))
            ends.append(len(codes))
        if len(self.known) > KEPT_WORDS:
            self.known, self.lossy = {}, set()
        ids = self.known
        fresh = self.encode_words(w for w in index if w not in ids)
        self.lossy |= {w for w, found in fresh.items() if b"".join(map(self.out.__getitem__, found)) != w.replace(MARK, " ").encode("utf-8", "surrogatepass")}
        ids |= fresh
        sizes = np.fromiter(map(len, map(ids.__getitem__, index)), np.int64, len(index))
        flat = np.fromiter(chain.from_iterable(map(ids.__getitem__, index)), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        at = np.array(codes, np.int64)
        size = sizes[at]
        stops = np.cumsum(size)
        gather = np.repeat(starts[at] - stops + size, size) + np.arange(int(size.sum()))
        lossy = np.fromiter(map(self.lossy.__contains__, index), np.int64, len(index))
        losses = np.concatenate(([0], np.cumsum(lossy[at])))[ends]
        whole = np.array([t is not None and MARK not in t for t in texts], bool) & (losses[1:] == losses[:-1])
        return flat[gather], np.concatenate(([0], stops))[ends], whole

    def decode(self, ids: Iterable[int]) -> str:
        out = self.out
        text = b"".join([out.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def codec_of(model: bytes) -> Codec:
    """A worker's codec, kept from task to task unless the last one gave it back."""
    return Codec(model)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) of runs of at most BLOCK_CHARS characters, or of one text."""
    start, held, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py()
        if held and size + len(text or "") > BLOCK_CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, keep: list[str] | None = None, stays: bool = True) -> DataFrame:
    """The id (and ``keep``), ``ids``, ``n_tokens`` and ``round_trip``: whether decoding gives the text back.

    ``stays``: workers keep the codec and the words it knows for the next task, which saves time; else a task gives their memory back.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in slices(batches, "__text"):
            names, texts = batch.schema.names[:-1], batch.column(batch.num_columns - 1)
            for start, block in _blocks(texts):
                flat, ends, whole = codec.encode_checked(block)
                missing = np.array([t is None for t in block])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(missing))
                columns = [batch.column(i).slice(start, len(block)) for i in range(len(names))]
                columns += [lists, pa.array(np.diff(ends), mask=missing), pa.array(whole, mask=missing)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "n_tokens", "round_trip"])
        if not stays:
            codec_of.cache_clear()

    rows = docs.select(F.col(id_col), *(F.col(c) for c in keep or ()), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(trimmed(encode), rows.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean"))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The id and the ``text`` of each row's ids; null ids have a null text."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [None if (ids := x.as_py()) is None else codec.decode(ids) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    return rows.mapInArrow(trimmed(decode), rows.select(id_col).schema.add("text", "string"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's whole text."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with language and source; other columns are dropped. The codec's memory is given back to the other stages' tasks."""
    return encode_documents(docs, keep=["lang", "source"], stays=False)
