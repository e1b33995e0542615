import random

import numpy as np
import pytest
from prose import prose
from pyspark.sql import functions as F

from millrace.llm.decontamination import Index, Settings, codes_of, find_passages, fold, gram_hashes, op3_decontamination, search_texts, stage

SMALL = "/root/testdata/sf0.001"


def nearest(passage, text):
    """Least edits of the passage against any part of the text."""
    row, codes = np.zeros(len(text) + 1, int), codes_of(text)
    at = np.arange(len(text) + 1)
    for i, c in enumerate(codes_of(passage), 1):
        step = np.append([i], np.minimum(row[:-1] + (codes != c), row[1:] + 1))
        row = np.minimum.accumulate(step - at) + at
    return int(row.min())


def edited(rng, passage, n):
    out = list(passage)
    for _ in range(n):
        i, how = rng.randrange(len(out)), rng.random()
        if how < 0.4:
            out[i] = rng.choice("abcdef ")
        elif how < 0.7:
            del out[i]
        else:
            out.insert(i, rng.choice("abcdef "))
    return fold("".join(out))


def test_against_brute_force():
    rng = random.Random(2)
    items = [(i, fold(prose(rng, n=rng.randint(6, 40)))) for i in range(30)]
    index, texts = Index(items, Settings()), []
    for k in range(120):
        n = rng.randrange(len(items))
        body = fold(prose(rng, n=rng.randint(0, 120)))
        at = rng.randint(0, len(body))
        texts.append(fold(body[:at] + " " + edited(rng, items[n][1], rng.randint(0, int(index.edits[n]) + 3)) + " " + body[at:]) if k % 4 else body)
    for text, found in zip(texts, search_texts(index, texts), strict=True):
        hits = {h["item_id"]: h for h in found}
        for n, (item, passage) in enumerate(items):
            least = nearest(passage, text)
            assert (least <= index.edits[n]) == (item in hits)
            if item in hits:
                assert hits[item]["edits"] == least
                assert nearest(text[hits[item]["start"] : hits[item]["stop"]], passage) <= least


def test_gram_hashes():
    codes = codes_of("abcdefghijabcdefghij")
    for q in range(1, 12):
        h = gram_hashes(codes, q)
        assert len(h) == 21 - q
        assert all((h[i] == h[j]) == ("abcdefghij" * 3)[i : i + q].startswith(("abcdefghij" * 3)[j : j + q]) for i in range(len(h)) for j in range(len(h)))


def test_long_texts_are_searched_throughout(monkeypatch):
    from millrace.llm import decontamination

    rng = random.Random(3)
    monkeypatch.setattr(decontamination, "STRETCH", 500)
    passage, body = fold(prose(rng, n=20)), fold(prose(rng, "de", 3000))
    index = Index([(1, passage)], Settings())
    for at in range(0, len(body), 977):
        text = fold(f"{body[:at]} {passage} {body[at:]}")
        (found,) = search_texts(index, [text])
        assert found[0]["edits"] == 0 and text[found[0]["start"] : found[0]["stop"]] == passage


def test_odd_rows(spark, odd_documents):
    docs = odd_documents.drop("hits")
    long = docs.where("doc_id = 54").first()["text"]
    items = spark.createDataFrame([(1, long[70_000:70_200], "x"), (2, None, "x"), (3, "short", "x"), (None, long[10:160], None), (4, long[70_000:70_200], "y")], "item_id long, text string, hits string")
    got = {(r["doc_id"], h["item_id"]) for r in find_passages(docs, items).collect() for h in r["hits"]}
    assert got == {(d, i) for d in (54, 55) for i in (1, None, 4)}
    blocks = find_passages(docs, items, settings=Settings(block_chars=250))
    assert got == {(r["doc_id"], h["item_id"]) for r in blocks.collect() for h in r["hits"]}
    assert find_passages(docs.where("false"), items).count() == 0
    assert all(r["hits"] == [] for r in find_passages(docs, items.where("false")).collect())


def test_blocks_give_the_same_rows_and_ids_keep_their_type(spark, odd_documents):
    """One block or many, with ids that are strings, repeated documents and repeated passages."""
    docs = odd_documents.drop("hits")
    rng = random.Random(12)
    texts = [r["text"] for r in docs.where("doc_id < 30").orderBy("doc_id").collect()]
    rows = [(f"item-{n % 9}", t[40:190]) for n, t in enumerate(texts[:12])] + [(None, texts[3][:99]), ("x", None), ("y", "ab"), ("z", prose(rng, n=30))]
    items = spark.createDataFrame(rows, "item_id string, text string")
    rows_of = lambda found: sorted((repr([r[c] for c in docs.columns]), sorted(map(repr, r["hits"]))) for r in found.collect())
    one, many = find_passages(docs, items), find_passages(docs, items, settings=Settings(block_chars=600))
    assert one.dtypes == many.dtypes and dict(one.dtypes)["hits"].startswith("array<struct<item_id:string,")
    assert rows_of(one) == rows_of(many)
    assert sum(len(r["hits"]) > 0 for r in many.collect()) >= 12


def test_query_and_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], fold(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {(r["doc_id"], i) for r in docs.collect() for i, p in items if p in fold(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, SMALL).where("edits = 0").collect()}
    assert got == exact and exact
    kept = stage(spark, docs.withColumn("hits", F.lit(1)), SMALL)
    assert kept.columns == [*docs.columns, "hits"]
    hit = {r["doc_id"] for r in op3_decontamination(spark, SMALL).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - hit


@pytest.mark.parametrize("text", ["", "a", "a" * 9, "ab" * 500_000])
def test_dull_texts(text):
    assert search_texts(Index([(1, "something else entirely here")], Settings()), [text, None]) == [[], []]


def test_passages_that_repeat_themselves():
    """Texts and passages of few q-grams: all pairs of them would be too many to hold."""
    rng = random.Random(4)
    dull = ["a" * 1000, "ab" * 300, "abcdefghijkl " * 60 + "end", "x" * 40]
    items = [(n, fold(t)) for n, t in enumerate([*dull, prose(rng, n=20)])]
    index = Index(items, Settings())
    texts = ["a" * 1_000_000, "b" * 5000, "a" * 400 + "c" + "a" * 599, "word " + "ab" * 299 + " tail", fold("abcdefghijkl " * 60) + " nd", "abcdefghijkl " * 5, "a" * 900, items[4][1], "x" * 39 + "y"]
    for text, found in zip(texts[1:], search_texts(index, texts)[1:], strict=True):
        want = {n for n, (_, p) in enumerate(items) if nearest(p, text) <= index.edits[n]}
        assert {h["item_id"] for h in found} == want, text[:40]
    assert {h["item_id"] for h in search_texts(index, texts[:1])[0]} == {0}


def test_short_passages_are_found_as_whole_words():
    index = Index([(1, "cat"), (2, "a cat"), (3, ""), (4, "cat"), (5, "ü 7")], Settings())
    texts = [fold(t) for t in ("A cat.", "concat a", "the CAT sat", "x Ü-7 y", "", "cata a cat")]
    got = [sorted((h["item_id"], t[h["start"] : h["stop"]]) for h in found) for t, found in zip(texts, search_texts(index, texts), strict=True)]
    assert got == [[(1, "cat"), (2, "a cat"), (4, "cat")], [], [(1, "cat"), (4, "cat")], [(5, "ü 7")], [], [(1, "cat"), (2, "a cat"), (4, "cat")]]


def test_clashing_column(spark):
    docs, items = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, hits int"), spark.createDataFrame([(1, "y")], "item_id long, text string")
    with pytest.raises(ValueError, match="hits"):
        find_passages(docs, items)
    assert find_passages(docs, items, out="found").columns == ["doc_id", "text", "hits", "found"]
