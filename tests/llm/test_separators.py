import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm import separators
from millrace.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encode():
    with open(separators.RANKS, "rb") as f:
        return separators.encoding(f.read(), separators.PATTERN).encode_ordinary


def test_roster():
    ids = [0, 1, -1, None, 2**63 - 1, -(2**63), 50256, None]
    for end in (2, 50256, 32768, 32767):
        digits = separators.roster_digits(ids, end)
        assert end not in digits.tolist() and digits.max() < 65536
        assert separators.roster_ids(digits, end) == [*ids, len(ids)]


def test_odd_rows(spark, odd_documents, no_documents, encode):
    got = separators.token_counts(odd_documents)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(encode(r["text"] or ""))) for r in odd_documents.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got.collect()) == want
    assert separators.token_counts(no_documents).count() == 0


@pytest.mark.parametrize(("block", "width"), [(1, 2), (2, 4), (7, 2), (64, 4), (1 << 20, 2)])
def test_blocks_are_stitched(spark, encode, block, width):
    rng = random.Random(block)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "<|endoftext|>", "x"]) for _ in range(rng.choice([0, 0, 1, 5, 60])))) for i in range(90)]
    path = Scratch(spark, "test_separators").path("flat")
    separators.write_flat(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3), path, width=width)
    counts = separators.scan_flat(spark, path, width=width, block=block).where("not last")
    got = counts.join(separators.read_rosters(spark, path, "doc_id", width=width), ["file", "ordinal"])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == [(i, len(encode(t))) for i, t in rows]


def test_cut_files_are_told(spark):
    path = Scratch(spark, "test_separators").path("cut")
    spark.createDataFrame([("ab" * 50,)], "value string").write.option("lineSep", "zz").text(path)
    with pytest.raises(Exception, match="does not end with a separator"):
        separators.scan_flat(spark, path).collect()


END = (50256).to_bytes(2, "little")


def files_of(spark, *contents):
    path = Scratch(spark, "test_separators").path("made")
    folder = Path(path.removeprefix("file:"))
    folder.mkdir(parents=True)
    for n, content in enumerate(contents):
        (folder / f"part-{n:05}").write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("content", [b"ab" * 50, b"ab" * 5 + END + b"ab" * 40, b"ab" * 5 + END + b"a", b"ab" * 9 + END + END + b"ab" * 3])
def test_files_that_end_early_are_told(spark, content):
    """No separator in several blocks, a last document without an end, and an odd count of bytes; beside a file that is whole."""
    path = files_of(spark, b"ab" * 7 + END, content)
    with pytest.raises(Exception, match="does not end with a separator"):
        separators.scan_flat(spark, path, block=4).collect()


def test_a_file_is_read_by_several_tasks(spark):
    path = files_of(spark, b"ab" * 100 + END + END + b"cd" * 300 + END)
    scan = separators.scan_flat(spark, path, block=8)
    assert [r["n_tokens"] for r in scan.orderBy("ordinal").collect()] == [100, 0, 300]
    files, ranged = separators._files(spark, path)
    assert ranged and files.columns == ["file", "length"]


def test_stores_that_only_spark_reads(spark, monkeypatch):
    """Where Arrow knows no file system for a path, whole files come with their content."""
    path = files_of(spark, b"ab" * 100 + END + END + b"cd" * 300 + END, b"ab" * 3 + END)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    monkeypatch.setattr(separators, "_files", lambda *_: (files, False))
    got = separators.scan_flat(spark, path, block=8).orderBy("file", "ordinal").collect()
    assert [r["n_tokens"] for r in got] == [100, 0, 300, 3]


def test_record_lengths():
    assert separators._record_bytes(1200, 2, 100) == 100
    assert separators._record_bytes(2 * 101, 2, 100) == 2
    assert separators._record_bytes(12, 4, 100) == 12


def test_large_files_that_only_spark_reads(spark, encode, monkeypatch):
    """Files above the bound are read as records through Hadoop, with their rosters, beside smaller ones that are read whole."""
    rng = random.Random(3)
    rows = [(None if i == 70 else i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(90)]
    path = Scratch(spark, "test_separators").path("large")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    separators.write_flat(docs.where("doc_id < 5").coalesce(1), path)
    more = Scratch(spark, "test_separators").path("more")
    separators.write_flat(docs.where("doc_id >= 5 or doc_id is null").coalesce(2), more)
    for file in Path(more.removeprefix("file:")).glob("part-*"):
        file.rename(Path(path.removeprefix("file:")) / f"part-more-{file.name}")
    monkeypatch.setattr(separators, "_reachable", lambda file: False)
    monkeypatch.setattr(separators, "WHOLE", 400)
    assert len(separators._large(*separators._files(spark, path))[1]) == 2
    for block in (16, 1 << 20):
        counts = separators.scan_flat(spark, path, block=block).where("not last")
        got = counts.join(separators.read_rosters(spark, path, "doc_id", block=block), ["file", "ordinal"])
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((-1 if i is None else i, len(encode(t))) for i, t in rows)


@pytest.mark.parametrize("content", [b"ab" * 50, b"ab" * 5 + END + b"a", b"ab" * 9 + END + END + b"ab" * 3])
def test_large_files_that_end_early_are_told(spark, monkeypatch, content):
    monkeypatch.setattr(separators, "_reachable", lambda file: False)
    monkeypatch.setattr(separators, "WHOLE", 4)
    path = files_of(spark, b"ab" * 7 + END, content)
    with pytest.raises(Exception, match="does not end with a separator"):
        separators.scan_flat(spark, path, block=4).collect()


def test_names_of_stores():
    assert separators.SCHEMES["s3a"] == "s3"
    assert separators._reachable("file:/etc/hostname") and not separators._reachable("file:/no/such/file")
    assert not separators._reachable("unknown-store://a/b")


def test_ids_that_do_not_fit(spark, odd_documents, tmp_path):
    wide = tmp_path / "wide.tiktoken"
    wide.write_bytes(b"YQ== 0\nYg== 70000\n")
    with pytest.raises(ValueError, match="2 bytes"):
        separators.write_flat(odd_documents, str(tmp_path / "out"), ranks=str(wide))
    with pytest.raises(ValueError, match="told apart"):
        separators.write_flat(odd_documents, str(tmp_path / "out"), end=17)


def test_query(spark, encode):
    docs = {r["doc_id"]: len(encode(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in separators.op9_token_counts(spark, SMALL).collect()} == docs
    assert separators.op9_token_counts(spark, SMALL).where(F.col("n_tokens").isNull()).count() == 0
