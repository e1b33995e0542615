"""Exact percentiles against Spark's own, which hold a group in one buffer."""

import random

from pyspark.sql import functions as F

from millrace.operators.ranks import exact_percentiles

FRACTIONS = {"least": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "most": 1.0}


def like_spark(df, keys):
    got = exact_percentiles(df, keys, "x", FRACTIONS)
    want = df.groupBy(*keys).agg(*(F.percentile("x", p).alias(n) for n, p in FRACTIONS.items()))
    rows = lambda d: sorted(repr([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.select(*keys, *FRACTIONS).collect())
    assert rows(got) == rows(want)
    return got


def test_groups_of_all_sizes(spark):
    """One group holds most rows, half of them of one value; others have one row, two, only nulls, or a null key."""
    random.seed(12)
    rows = [("big", 1, random.choice([7.0, random.gauss(0, 100)])) for _ in range(6000)]
    rows += [("one", 1, 3.5), ("two", 1, 1.0), ("two", 1, 2.0), ("none", 1, None), ("none", None, None), (None, None, 4.0), (None, None, -4.0)]
    rows += [("some", 2, random.choice([None, random.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, j int, x double")
    assert like_spark(df, ["k", "j"]).count() == 7
    assert like_spark(df, ["k"]).columns == ["k", *FRACTIONS]


def test_whole_numbers_infinities_and_no_rows(spark):
    like_spark(spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("x")), ["k"])
    like_spark(spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 2.0)], "k int, x double"), ["k"])
    assert exact_percentiles(spark.createDataFrame([], "k int, x double"), ["k"], "x", FRACTIONS).count() == 0
