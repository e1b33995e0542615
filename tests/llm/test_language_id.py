import math
import random
import zlib

import duckdb
import pytest
import regex
import zstandard
from prose import prose
from pyspark.sql import functions as F

from millrace.llm import language_id


def test_odd_rows(spark, odd_documents):
    got = language_id.identify(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    for i in (50, 51, 52, 53):
        assert by[i][0]["lang_pred"] == "und" and not by[i][0]["accepted"] and by[i][0]["score"] == 0
    assert by[54][0]["lang_pred"] == "en"
    assert by[57][0] == by[57][1]


def test_empty(no_documents):
    assert language_id.identify(no_documents).count() == 0


def test_nothing_to_learn_from(odd_documents):
    got = language_id.identify(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}


def test_one_language(odd_documents):
    got = language_id.identify(odd_documents.where("lang = 'en' and length(text) > 2")).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("en", 1.0)}


def test_held_out_rows_teach_nothing(spark, odd_documents):
    """Other labels on held-out rows change no prediction."""
    shown = odd_documents.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a = language_id.identify(odd_documents).orderBy("doc_id").collect()
    assert a == language_id.identify(shown).orderBy("doc_id").collect()
    assert any(r["held_out"] for r in a)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in language_id.op1_language_id(spark, sf).collect()}
    truth = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(truth)
    kept = [(got[i]["lang_pred"], lang) for i, lang in truth if got[i]["held_out"]]
    assert sum(a == b for a, b in kept) / len(kept) > 0.95
    assert sum(r["accepted"] for r in got.values()) / len(got) > 0.97


def test_stage_keeps_columns(spark, odd_documents):
    kept = language_id.stage(spark, odd_documents, "")
    assert kept.columns == odd_documents.columns
    assert not {50, 51, 52, 53} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("text", ["a" * 3_000_000, "é ß " * 100_000])
def test_very_long(text):
    encoder = language_id.Encoder([("en", b"the quick brown fox " * 50), ("de", b"der schnelle braune fuchs " * 50)], language_id.Settings())
    lang, score = encoder.predict(text)
    assert lang in ("en", "de") and 0 <= score <= 1


def test_no_language_is_lost(spark):
    """Rows of few ids, a language of one short row, and one without letters: each is learnt, from as many rows as the bound allows."""
    rng = random.Random(4)
    rows = [(i % 2 * 3, prose(rng, lang, 20), lang) for i in range(1000) for lang in ("en", "de")]
    rows += [(0, "ab", "xx"), (3, "12", "yy")]
    docs = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, text string, lang string")
    learnt = language_id.learn(docs, "doc_id", "text", "lang", language_id.Settings(sample_rows=7))
    assert {name for name, _ in learnt} == {"en", "de", "xx", "yy"} and all(len(d) >= 8 for _, d in learnt)
    by = {name: d.decode() for name, d in learnt}
    for lang in ("en", "de"):
        texts = [language_id.normal(t).decode() for _, t, name in rows if name == lang]
        assert sum(t in by[lang] for t in texts) == 7
    # Of rows that are alike in id and text, none of the least hashes may be there.
    same = spark.createDataFrame([(1, "one and the same text", "en")] * 3000 + [(3, "etwas anderes", "de")], "doc_id long, text string, lang string")
    assert {name for name, _ in language_id.learn(same, "doc_id", "text", "lang", language_id.Settings(sample_rows=2))} == {"en", "de"}


def test_many_languages(spark):
    rows = [(n * 4 + k, prose(random.Random(n), "en", 30), f"l{n:03}") for n in range(300) for k in range(3)]
    learnt = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", language_id.Settings())
    assert len(learnt) >= 295


def test_smallest_sum_wins(spark, odd_documents):
    """Every prediction and score against sums that are compressed anew, with repeated ids, ties and short texts."""
    rng = random.Random(6)
    rows = [(i % 40, prose(rng, lang, n), lang) for i, (lang, n) in enumerate([("en", 60), ("de", 60), ("en", 3), ("de", 1)] * 30)] + [(100, "zzz", None), (101, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = language_id.Settings(sample_rows=20)
    learnt = language_id.learn(docs, "doc_id", "text", "lang", settings)

    def size(data, dictionary):
        shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=settings.level)
        return len(zstandard.ZstdCompressor(level=settings.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    def plainly(text):
        data = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip().encode()
        blocks = [data[i : i + settings.block_bytes] for i in range(0, len(data), settings.block_bytes)]
        sums = [(sum(size(b, d) for b in blocks), n) for n, (_, d) in enumerate(learnt)]
        low, next_ = sorted(sums)[:2]
        if next_[0] - low[0] <= 2:
            cuts = [blocks[0][: math.ceil(len(blocks[0]) * i / 8)] for i in range(1, 8)]
            sums = [(s + sum(size(c, learnt[n][1]) for c in cuts), n) for s, n in sums]
            low, next_ = sorted(sums)[:2]
        return learnt[low[1]][0], (next_[0] - low[0]) / next_[0]

    for r in language_id.identify(docs.withColumn("score", F.lit("clash")).withColumn("keep", F.lit(1)), settings=settings, keep=["doc_id", "text"]).collect():
        assert (r["lang_pred"], r["score"]) == plainly(r["keep"]["text"])


def test_marks_are_kept():
    assert language_id.normal("हिन्दी में 12 पाठ!").decode() == "हिन्दी में पाठ"
    assert language_id.normal("It's 5 o'Clock_x") == b"it s o clock x"
