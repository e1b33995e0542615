"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Parts that a group's values are cut into, about equal in rows.
PARTS = 256


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For each group the values at the given fractions of its order, interpolated between neighbours.

    Equal values are counted first. A sketch cuts each group's values into PARTS parts, and their counts say
    which parts hold the places asked for; only those are sorted. So no group stands in one buffer or task, and the sketch decides
    nothing but the size of parts.
    Nulls are left out; a group with none but nulls has null percentiles. A null key is a group.
    """
    rows = df.select(F.struct(*keys).alias("__key"), F.col(value).cast("double").alias("__value"))
    cuts = rows.groupBy("__key").agg(F.percentile_approx("__value", [n / PARTS for n in range(1, PARTS)], 10 * PARTS).alias("__cuts"), F.count("__value").alias("__total"))
    counted = rows.where("__value is not null").groupBy("__key", "__value").agg(F.count(F.lit(1)).alias("__n"))
    below = F.size(F.filter("__cuts", lambda c: c < F.col("__value")))
    placed = counted.join(cuts, "__key").select("__key", "__value", "__n", "__total", below.alias("__part"))

    running = lambda w: w.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    sizes = placed.groupBy("__key", "__part").agg(F.sum("__n").alias("__size"), F.first("__total").alias("__of"))
    sizes = sizes.withColumn("__end", F.sum("__size").over(running(W.Window.partitionBy("__key").orderBy("__part")))).withColumn("__start", F.col("__end") - F.col("__size"))
    spot = {name: F.lit(f) * (F.col("__of") - 1) for name, f in fractions.items()}
    sides = [side(at).cast("long") for at in spot.values() for side in (F.floor, F.ceil)]
    holds = F.exists(F.array(*sides), lambda at: (at >= F.col("__start")) & (at < F.col("__end")))
    parts = sizes.where(holds).select("__key", "__part", "__start", "__of")

    order = W.Window.partitionBy("__key", "__part").orderBy("__value")
    ranked = placed.join(parts, ["__key", "__part"]).withColumn("__to", F.col("__start") + F.sum("__n").over(running(order))).withColumn("__from", F.col("__to") - F.col("__n"))
    at_place = lambda at: F.max(F.when((at.cast("long") >= F.col("__from")) & (at.cast("long") < F.col("__to")), F.col("__value")))
    found = []
    for name, at in spot.items():
        low, high, share = at_place(F.floor(at)), at_place(F.ceil(at)), F.max(at - F.floor(at))
        found.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return cuts.select("__key").join(ranked.groupBy("__key").agg(*found), "__key", "left").select("__key.*", *fractions)
