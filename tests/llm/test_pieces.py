import itertools
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import pieces

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def lists(codec, texts):
    flat, ends = codec.encode(texts)
    return [flat[a:b].tolist() for a, b in itertools.pairwise(ends)]


def test_like_the_library(codec, library):
    rng = random.Random(5)
    letters = "aaabcdeeiost  \n\t.,'éß日本<s>0x0A thing the ▁​😀"
    texts = ["", " ", "  a  b ", "a" * 500, "\n\n", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3000))]
    for text, ids in zip(texts, lists(codec, texts), strict=True):
        assert ids == library.encode(text), text
        if pieces.MARK not in text:
            assert codec.decode(ids) == text


def test_unigram_is_the_best_sum():
    rng = random.Random(6)
    words = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if "▁" not in "".join(p).lstrip("▁")}
    table = {w: (i, -rng.random() * 5) for i, w in enumerate(sorted(words))}
    codec = pieces.Codec.of(table, pieces.UNIGRAM)
    names = {i: w for w, (i, _) in table.items()}
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        whole = "▁" + text

        def best(s):
            return max((table[s[:k]][1] + best(s[k:]) for k in range(1, min(3, len(s)) + 1) if s[:k] in table), default=float("-inf")) if s else 0.0

        (ids,) = lists(codec, [text])
        assert "".join(names[i] for i in ids) == whole
        assert sum(table[names[i]][1] for i in ids) == pytest.approx(best(whole))


def test_unknown_without_bytes():
    codec = pieces.Codec.of({"▁": (1, -1.0), "a": (2, -1.0), "▁a": (3, -1.5)}, pieces.BPE, unknown=0)
    assert lists(codec, ["a?a"]) == [[3, 0, 2]]


def test_odd_rows(spark, odd_documents, library):
    got = pieces.encode_documents(odd_documents, keep=["ids" if "ids" in odd_documents.columns else "lang"]).collect()
    texts = {}
    for r in odd_documents.collect():
        texts.setdefault(r["doc_id"], r["text"])
    assert len(got) == odd_documents.count()
    for r in got:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]]
            assert r["ids"] == (None if text is None else library.encode(text))
            assert r["n_tokens"] == (None if text is None else len(r["ids"])) and r["round_trip"] == (None if text is None else True)


def test_decode_and_empty(spark, odd_documents, no_documents):
    docs = odd_documents.where("doc_id < 60")
    encoded = pieces.encode_documents(docs)
    back = pieces.decode_documents(encoded)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
    assert pieces.encode_documents(no_documents).count() == 0


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = pieces.op7_sentencepiece(spark, SMALL).collect()
    assert len(got) == len(docs) and all(r["ids"] == library.encode(docs[r["doc_id"]]) for r in got)
    assert pieces.op7_sentencepiece(spark, SMALL).where(~F.col("round_trip")).count() == 0
