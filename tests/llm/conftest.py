import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from prose import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    base = [(i, prose(rng, lang, 80), lang) for i, lang in enumerate(["en", "de"] * 20)]
    long = prose(rng, "en", 30_000)
    rows = [
        *base,
        (50, None, "en"), (51, "", None), (52, " \t\n ", "de"), (53, "12 34 !!", None), (54, long, "en"), (55, long + " end", "en"),
        (56, base[0][1], "en"), (57, base[0][1], None), (57, base[0][1], None), (None, base[2][1], None), (None, None, None),
        (58, "x" * 200_000, "en"), (59, base[4][1].upper(), "en"), (60, "ab", "en"), (61, "ab", "en"),
    ]
    rows = [(i, t, lang, "src", None if t is None else len(t), i, "h", "r", 1.0, 3, "k") for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, hits string, runs string, score double, shard int, key string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
