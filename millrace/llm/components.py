"""Connected components of a graph given by its edges: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours. The minimum is combined before the shuffle."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(smallest, F.col("u") == F.col("k")).drop("k")


def components(edges: DataFrame, scratch: Scratch, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, the root being the smallest node that it reaches.

    ``edges`` has two columns of one ordered type; edges to oneself and repeated edges do no harm. Every
    round is written to the shared folder, so lineage stays short.
    """
    a, b = (F.col(c) for c in edges.columns)
    at = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{label}-0")
    state = None
    if at.isEmpty():
        return at.toDF("node", "root")
    for k in range(1, max_rounds + 1):
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.write(_with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-{k}l")
        small = _with_smallest(large)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        after = scratch.write(star.where("u > v").distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k}l")
        scratch.drop(f"{label}-{k - 1}")
        at, last = after, state
        got = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (got["n"], got["h"])
        if state == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
