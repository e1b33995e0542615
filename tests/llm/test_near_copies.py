"""The pipeline's SimHash stage against Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import linking, simhash
from millrace.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(docs):
    """What is kept of (id, text) rows if similar pairs are connected, and the similar pairs."""
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    pairs = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                pairs.append((j, i))
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    return {docs[i][0] for i in set(label)}, pairs


def mutated(rng, text, most):
    words = text.split()
    for _ in range(rng.randint(1, most)):
        words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Texts of 60 to 400 words and copies with up to 6 % of their words changed."""
    rng, out = random.Random(3), []
    for _ in range(150):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 400])))
        out += [text, *(mutated(rng, text, max(1, len(text.split()) // 17)) for _ in range(rng.randint(1, 2)))]
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_finds_similar_pairs(spark, rows):
    want, pairs = brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.stage(spark, docs, SMALL).collect()}
    assert len(pairs) > 50
    assert want <= kept, "a document without a similar one is gone"
    assert len(kept - want) <= 0.05 * (len(rows) - len(want)), "near copies are left"


def test_links_leave_out_what_is_known():
    known = ["a", "a", "b", "c", "c"]
    assert linking.fresh([(0, 1), (0, 2), (1, 2), (3, 4), (2, 3), (0, 4)], known) == [(0, 2), (2, 3)]
    assert linking.fresh([(0, 1), (1, 2), (0, 2)], [1, 2, 3]) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("block_rows", [2048, 9])
def test_known_components_do_not_change_the_groups(spark, block_rows):
    """Codes of one key, in one block or many: the components are the same, and links within what is known aren't handed out."""
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = sorted({rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(2)) for _ in range(160)})
    near = np.bitwise_count(np.array(codes, np.uint64)[:, None] ^ np.array(codes, np.uint64)[None, :]) <= 3
    known = np.arange(len(codes))
    for i, j in rng.sample(np.argwhere(near).tolist(), 120):
        known[known == max(known[i], known[j])] = min(known[i], known[j])

    def label(start, edges):
        out = start.copy()
        for a, b in edges:
            out[out == max(out[a], out[b])] = min(out[a], out[b])
        return out

    rows = [(7, i, c.to_bytes(8, "big"), int(k)) for i, (c, k) in enumerate(zip(codes, known, strict=True))]
    members = spark.createDataFrame(rows, "grp long, node long, data binary, known long")
    edges = [(r["a"], r["b"]) for r in linking.group_links(members, Scratch(spark, "test_near_copies"), "known", linking.hamming_forest(3), block_rows).collect()]
    want = label(np.arange(len(codes)), np.argwhere(near).tolist())
    assert (label(known, edges) == want).all()
    assert all(known[a] != known[b] for a, b in edges)
    assert block_rows < len(codes) or len(edges) < len(codes)


def similar_pair(rng, words):
    """A text and the text with words appended, as many as a Jaccard similarity of 0.8 or just above allows."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return " ".join(text), " ".join([*text, *(f"w{rng.randrange(10**6)}" for _ in range((words - 4) // 4))])


@pytest.mark.parametrize("widths, thresholds", [([22, 21, 21], [1, 1, 0]), ([32, 32], [2, 1]), ([16, 16, 16, 16], [0, 0, 0, 1]), ([13, 13, 13, 13, 12], [0] * 5)])
@pytest.mark.parametrize("words", [9, 14, 60, 300])
def test_recall_holds_for_every_layout(widths, thresholds, words):
    """Near copies at the threshold meet under a key and pass the comparison, however wide the keys of a large table are."""
    rng = random.Random(words)
    seeds = max(simhash.STAGE_SEEDS, simhash.seeds_for(widths, thresholds, simhash.near_rate(0.8), simhash.STAGE_RECALL))
    assert seeds <= simhash.MOST_SEEDS
    bounds = np.cumsum([0, *widths])
    masks = simhash.masks_of([list(range(a, b)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], thresholds)
    found = 0
    for _ in range(200):
        a, b = similar_pair(rng, words)
        assert len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
        x, y = (
            simhash.majorities(np.stack([simhash.reseeded(simhash.shingle_hashes(t.encode(), 3), k) for k in range(seeds)], axis=1))
            for t in (a, b)
        )
        differ = x ^ y
        meet = any(not (int(d) & m) for d in differ for m in masks)
        found += meet and int(np.bitwise_count(differ).sum()) <= int(seeds * simhash.BITS * simhash.FAR)
    assert found >= 0.9 * 200


def test_wider_keys_get_more_fingerprints():
    rate = simhash.near_rate(0.8)
    seeds = [simhash.seeds_for(w, t, rate, 0.95) for w, t in (([13, 13, 13, 13, 12], [0] * 5), ([22, 21, 21], [1, 1, 0]), ([32, 32], [2, 1]))]
    assert seeds == sorted(seeds) and seeds[0] < seeds[-1]
    assert simhash.found_share([32, 32], [-1, -1], rate) == 0 and simhash.found_share([4], [4], rate) == pytest.approx(1)


def test_stage_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want, _ = brute_force(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SMALL).collect()} == want


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_blocks_do_not_change_the_groups(spark, rows, block_rows):
    """All texts in one cluster, whole or in blocks."""
    want, _ = brute_force(rows)
    texts = spark.createDataFrame([(f"{i:09}", t.encode()) for i, t in rows], "digest string, text binary")
    clusters = texts.selectExpr("digest", "'one' AS cluster")
    edges = simhash.similar_texts(clusters, texts, Scratch(spark, "test_near_copies"), 0.8, block_rows)
    label = np.arange(len(rows))
    for a, b in [(int(r["a"]), int(r["b"])) for r in edges.collect()]:
        x, y = sorted((label[a], label[b]))
        label[label == y] = x
    assert set(label.tolist()) == want


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text), (2, "another text of few words"), (3, None), (4, " \n"), (None, text), (None, None), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.stage(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, text), (1, text), (2, "another text of few words"), (3, "")]
