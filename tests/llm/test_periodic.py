import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import periodic

SMALL = "/root/testdata/sf0.001"


def brute(w, least=periodic.MIN_WORDS):
    """Every stretch that keeps a period as long as it can, unless a smaller period holds in it."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, 2 * q) and not any(w[start : start + length - d] == w[start + d : start + length] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    greatest = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *greatest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


words = st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k).map(lambda x: b"%d" % x), max_size=60))


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.sampled_from([2, 5, 12]))
def test_runs_are_those_of_brute_force(texts, least):
    assert periodic.runs_of(texts, least) == [brute(w, least) for w in texts]


def test_runs_within_runs_and_in_few_words():
    rng = random.Random(2)
    for _ in range(60):
        root = [b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        inner = root * rng.randrange(1, 5) + root[: rng.randrange(len(root))]
        text = [b"x"] * rng.randrange(3) + (inner + [b"y"] * rng.randrange(2)) * rng.randrange(1, 5) + [b"z"]
        assert periodic.runs_of([text, text[::-1]]) == [brute(text), brute(text[::-1])]


def test_suffix_array_and_intervals():
    """Order and common prefixes are those of plain sorting, text by text; intervals are those that a scan finds."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(40):
        texts = [[rng.randrange(2) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        codes = np.array([10 * t + x for t, text in enumerate(texts) for x in text])
        sizes = np.array([len(t) for t in texts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        order, inverse, lcp = periodic.suffix_array(codes, ends)
        suffix = [codes[i : ends[i]].tolist() for i in range(len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: suffix[i])
        assert inverse[order].tolist() == list(range(len(codes)))
        alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [0, *(alike(suffix[a], suffix[b]) for a, b in zip(order[:-1], order[1:], strict=True))]
        assert lcp.tolist() == want
        depth, left, right, owner = periodic.lcp_intervals(lcp)
        got = set(zip(depth.tolist(), left.tolist(), right.tolist(), strict=True))
        spans = set()
        for k, v in enumerate(want):
            if v:
                a = next(i for i in range(k - 1, -1, -1) if want[i] < v)
                b = next((i for i in range(k + 1, len(want)) if want[i] < v), len(want)) - 1
                spans.add((v, a, b))
                assert (depth[owner[k]], left[owner[k]], right[owner[k]]) == (v, a, b)
            else:
                assert owner[k] == -1
        assert got == spans


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: digests(planted(r["text"].split(), r["doc_id"])) for r in docs}
    assert any(g[0] for g in got.values())


def test_planted_words_are_those_of_the_contract(spark):
    rows = [(i, t) for i in range(200) for t in (None, "", " \t", "one", "a b\x0bc d e f\n g h i j k l m")] + [(None, "a b")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = table.select("doc_id", "text", periodic.with_planted_runs(F.col("text"), F.col("doc_id")).alias("out")).collect()
    for r in got:
        want = r["text"] if r["doc_id"] is None else planted([w.decode() for w in (r["text"] or "").encode().split()], r["doc_id"])
        assert r["out"] == want if r["doc_id"] is None else [w.decode() for w in (r["out"] or "").encode().split()] == want


def test_odd_documents(spark, odd_documents, no_documents):
    """Nulls, empty, blank and very long texts, repeated rows and clashing names; planted runs in all of them."""
    long = " ".join(f"w{i % 7000}" for i in range(30_000)) + " end"
    table = odd_documents.select("doc_id", F.concat_ws(" ", "text", F.repeat(F.lit("again and "), 9)).alias("text"), "runs").unionAll(
        spark.createDataFrame([(70, long, "r"), (71, None, "r"), (71, None, "r"), (72, "", None), (73, " \n ", None), (74, "a " * 11, None), (75, "a " * 12, None)], "doc_id long, text string, runs string")
    )
    rows = table.select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(table).collect()), key=str)
    want = []
    for r in rows:
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        runs = [(0, 30_000, 7000)] if r["doc_id"] == 70 else brute(w) if len(w) < 3000 else None
        if runs is None:
            runs = brute(w[-40:])
            runs = [(s + len(w) - 40, n, q) for s, n, q in runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r["doc_id"], runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(no_documents).count() == 0
