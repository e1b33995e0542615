import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from differential import connect, differences
from prose import prose
from pyspark.sql import functions as F
from pyspark.sql import window

from millrace.llm import simhash, substrings

SMALL = "/root/testdata/sf0.001"
W = substrings.WINDOW


def brute(rows):
    """(id, words, removed, digest) by comparing all windows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - W + 1):
                key = tuple(words[k : k + W])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = {k + j for k in range(len(words) - W + 1) if i is not None and first[tuple(words[k : k + W])] < i for j in range(W)}
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((-1 if i is None else i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def run(spark, docs, **settings):
    scratch = substrings.Scratch(spark, "test_substrings")
    known, runs = substrings.find_runs(docs, scratch, "doc_id", "text", **settings)
    got = substrings.removed(known, runs, substrings._rows(docs, "doc_id", "text"), scratch)
    return sorted((-1 if r["id"] is None else r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())


def shared_passages():
    rng = random.Random(11)
    phrases = [prose(rng, n=n).split() for n in (12, 13, 14, 30, 90)]
    rows = []
    for i in range(120):
        words = prose(rng, n=rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            phrase = rng.choice(phrases)
            a = rng.randint(0, len(phrase) - 1)
            at = rng.randint(0, len(words))
            words[at:at] = phrase[a : a + rng.randint(1, 90)] if rng.random() < 0.5 else phrase
        rows.append((i * 3 % 120, rng.choice([" ", "\n", " \t"]).join(words)))
    common = "a b " * 40
    return [*rows, (200, common), (201, common + "c"), (202, "x " + common), (203, rows[0][1]), (203, rows[0][1]), (204, rows[5][1].replace(" ", "\n"))]


@pytest.mark.parametrize("settings", [{}, {"windows_per_shard": 20, "parts_per_task": 2}])
def test_against_brute_force(spark, settings):
    rows = shared_passages()
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string"), **settings) == brute(rows)


def long_texts(n=12):
    """Texts of several parts, with passages across their edges and at odd places; one of them with a common passage throughout."""
    rng, part = random.Random(23), substrings.PART
    passages = [prose(rng, n=k).split() for k in (W - 1, W, 40, part + 30)]
    rows = []
    for i in range(n):
        words = prose(rng, n=rng.randint(1, 5 * part)).split()
        for edge in range(part, len(words), part):
            words[edge - (at := rng.randint(0, W)) : edge - at] = rng.choice(passages)
        rows.append((i, " ".join(words)))
    return [*rows, (n, " ".join(passages[2] * 60)), (n + 1, " ".join(passages[3] * 3))]


@pytest.mark.parametrize("common", [0, 4096])
def test_parts_of_long_texts(spark, monkeypatch, common):
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "MOST_COMMON", 1 << 30)
    rows = long_texts()
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string"), windows_per_shard=50, parts_per_task=3) == brute(rows)


def test_only_parts_are_sent(spark):
    """Of a long text only the part that is named is sent; texts that end before it send none."""
    wants = [{"shard": 4, "salt": 2, "part": 1, "places": [substrings.PART + 3]}, {"shard": 5, "salt": 0, "part": 9, "places": None}]
    words = [f"w{i}" for i in range(2 * substrings.PART + 5)]
    schema = "id long, key long, text binary, wants array<struct<shard int, salt int, part int, places array<int>>>"
    texts = spark.createDataFrame([(1, 7, " ".join(words).encode(), wants), (2, 8, b"", wants)], schema)
    got = [(r["id"], r["key"], r["shard"], r["salt"], r["start"], r["places"], bytes(r["text"]).decode().split()) for r in substrings.parts_of(texts, 1).collect()]
    assert got == [(1, 7, 4, 2, substrings.PART, [substrings.PART + 3], words[substrings.PART :])]


def test_bitmap_that_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_BITMAP_BITS", 10)
    rows = shared_passages()
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("common", [0, 4])
def test_common_anchors(spark, monkeypatch, common):
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "MOST_COMMON", 1 << 30)
    rows = shared_passages()
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_common_anchors_are_few(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", 1)
    monkeypatch.setattr(substrings, "MOST_COMMON", 10)
    got = substrings.common_anchors(spark.createDataFrame([(-1, 2), (5, 3), (7, 30), (8, 1)], "phrase long, n long"))
    assert got.tolist() == [7]
    monkeypatch.setattr(substrings, "MOST_COMMON", 100)
    assert substrings.common_anchors(spark.createDataFrame([(-1, 2), (5, 3), (7, 30), (8, 1)], "phrase long, n long")).tolist() == [5, 7, (1 << 64) - 1]


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert run(spark, odd_documents) == brute(rows)
    assert run(spark, no_documents) == []


def test_segments_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n=n).encode().split() for n in (5, 12, 13, 14, 200, 1000)]
    whole = [(int(r), int(a), int(h), int(p)) for x in substrings.windows(texts) for r, a, h, p in zip(x.row, x.at, x.hash(W)[x.whole], x.anchor, strict=True)]
    monkeypatch.setattr(substrings, "SEGMENT", 50)
    monkeypatch.setattr(substrings, "BLOCK", 300)
    assert whole == [(int(r), int(a), int(h), int(p)) for x in substrings.windows(texts) for r, a, h, p in zip(x.row, x.at, x.hash(W)[x.whole], x.anchor, strict=True)]
    assert len(whole) == sum(max(0, len(t) - W + 1) for t in texts)
    by = {}
    for row, at, h, _ in whole:
        by.setdefault(h, set()).add(tuple(texts[row][at : at + W]))
    assert all(len(v) == 1 for v in by.values())


def test_cut_text():
    assert substrings.cut_text("a  b\nc d\n", [1, 3]) == "a  d\n"
    assert substrings.cut_text(" é b", [0, 1]) == " b"
    assert substrings.cut_text("a b", [0, 2]) == ""
    assert substrings.cut_text("a b c d", [0, 2, 1, 3]) == "d"


def test_cut_documents(spark, odd_documents):
    got = substrings.cut_documents(odd_documents)
    assert got.columns == odd_documents.columns
    want = {(i, d) for i, n, gone, d in brute([(r["doc_id"], r["text"]) for r in odd_documents.collect()]) if not gone or gone < n}
    rows = {(-1 if r["doc_id"] is None else r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in got.collect()}
    assert rows == want
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in got.collect() if r["doc_id"] in range(40))


def test_like_sql(spark):
    assert not differences(substrings.op10_substring_dedup(spark, SMALL), connect(SMALL), substrings.ORACLE)


def test_an_id_with_a_copy_and_another_text(spark):
    """Id 2 has a copy of id 1's text and a text that holds a passage of id 0."""
    rng = random.Random(17)
    a, b, c = (prose(rng, n=60) for _ in range(3))
    rows = [(0, a), (1, b), (2, b), (2, f"{c} {' '.join(a.split()[10:40])}")]
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("kind", [int, str])
def test_a_task_hands_out_a_window_of_many_documents_once(kind):
    """Places, largest documents and counts are those of all rows, however few are held at a time."""
    rng = random.Random(3)
    rows = [(rng.randrange(50), kind(rng.randrange(30)), rng.randrange(9)) for _ in range(3000)]

    def batches():
        for i in range(0, len(rows), 37):
            w, d, a = (pa.array(x, t) for x, t in zip(zip(*rows[i : i + 37], strict=True), (pa.int64(), None, pa.int32()), strict=True))
            yield pa.RecordBatch.from_arrays([w, d, a, d, pa.array([1] * len(w), pa.int64())], names=["window", "id", "at", "last", "n"])

    want: dict = {}
    for w, d, a in rows:
        first, last, n = want.get(w, ((d, a), d, 0))
        want[w] = (min(first, (d, a)), max(last, d), n + 1)
    for most, handed_out in ((64, len(rows)), (200, 50), (1 << 18, 50)):
        made = [r for b in substrings._fold(batches(), most) for r in b.to_pylist()]
        assert len(made) <= handed_out
        got: dict = {}
        for r in made:
            first, last, n = got.get(r["window"], ((r["id"], r["at"]), r["last"], 0))
            got[r["window"]] = (min(first, (r["id"], r["at"])), max(last, r["last"]), n + r["n"])
        assert got == want


def test_windows_of_one_anchor_are_shuffled_as_one_row(spark):
    """None is lost, and equal windows are dealt alike; those of a common anchor go one by one, each dealt by itself."""
    rows = shared_passages()
    docs = substrings._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    blocks = list(substrings.windows([t.encode().split() for _, t in rows]))
    want = sorted((int(h), rows[r][0], int(a)) for x in blocks for r, a, h in zip(x.row, x.at, x.hash(W)[x.whole].view(np.int64), strict=True))
    everything, none = np.full(16, (1 << 64) - 1, np.uint64), np.empty(0, np.uint64)
    places = substrings.Places(pa.table({"window": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "at": pa.array([], pa.int32())}))
    for common, alone in ((none, False), (np.unique(np.concatenate([x.anchor for x in blocks])), True)):
        spots = substrings.occurrences(docs, everything, 10, common, places)
        got = spots.collect()
        assert sorted((r["window"], r["id"], r["at"]) for r in got) == want
        dealt = {(r["deal"], r["window"]) for r in got}
        assert len(dealt) == len({w for _, w in dealt})
        assert (len({d for d, _ in dealt}) == len(dealt)) == alone
        sent = substrings._marked(docs, everything, 10, common, "deal int, id {0}, at int, windows array<long>, source {0}, chunk int", substrings._spots_and_routes, places)
        assert sent.count() == len(want) if alone else sent.count() * 3 < len(want)
        # Grouping by window takes no shuffle but that one.
        least = spots.withColumn("least", F.min("id").over(window.Window.partitionBy("deal", "window")))
        assert least._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_search_tables_are_dropped(spark, odd_documents, monkeypatch):
    """What a stage hands on needs the tables of its losses only."""
    made = []

    class Watched(substrings.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(Path(self.base.removeprefix("file://")))

    monkeypatch.setattr(substrings, "Scratch", Watched)
    monkeypatch.setattr(simhash, "Scratch", Watched)
    for stage, left in ((substrings.stage, {"losses", "loss_ids"}), (simhash.stage, {"gone", "gone_ids"})):
        made.clear()
        rows = stage(spark, odd_documents, "").count()
        assert rows > 0
        assert {p.name for base in made if base.exists() for p in base.iterdir() if p.is_dir()} == left
