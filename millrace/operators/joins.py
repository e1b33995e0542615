"""Joins that Spark has no operator for, composed of those that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


#: Bins of a level are so many times as wide as those of the level below.
STEP = 64
#: Levels of bins; ranges longer than the widest bin share one that every point is in.
LEVELS = 9
#: Bins are numbered up to here in either direction; what lies further out shares the last one.
LAST_BIN = float(2**62)
#: Rows of either side in a cell, the piece of a group that one task compares, and most tasks asked for.
LEFTS, RIGHTS, TASKS = 1 << 14, 1 << 13, 4096
#: Rows of a class that stand in one array: Spark holds the pairs of two arrays at a time.
CLASS = 16


def _classes(df: DataFrame, by: list[str], keys: list[str], out: str) -> tuple[DataFrame, list[Column]]:
    """Rows of a cell that are alike in ``keys`` as arrays ``out`` of at most CLASS of them, and the columns to select once these are exploded."""
    rest = [c for c in df.columns if c not in by and c not in keys]
    # A column by itself is taken out of its structs only now: collect_list leaves out nulls.
    held, one = F.struct(*rest or [F.lit(0)]), len(rest) == 1
    pieces = F.transform(F.sequence(F.lit(1), F.size(out), F.lit(CLASS)), lambda at: F.slice(out, at, CLASS))
    grouped = df.groupBy(*by, *keys).agg(F.collect_list(held).alias(out)).withColumn(out, F.col(out)[rest[0]] if one else F.col(out))
    columns = [F.col(c) if c in keys else F.col(out).alias(c) if one else F.col(out)[c].alias(c) for c in df.columns if c not in by]
    return grouped.withColumn(out, F.explode(pieces)), columns


def cell_join(left: DataFrame, right: DataFrame, by: list[str], condition: Column, left_keys: list[str], right_keys: list[str], lefts: int = LEFTS, rights: int = RIGHTS) -> DataFrame:
    """Pairs with equal ``by`` (numbers, never null) for which a condition on the sides' keys holds, however many rows a group has.

    A group with more than ``lefts`` or ``rights`` rows is cut into parts on both sides, each part of one side meets each of the other
    in a cell, and cells are numbered and dealt to tasks in turn: a hash would give some tasks several cells and others none. So no task compares more than its cells, a cell's right rows are what is held in memory, and each row is
    sent once for each part of the other side. In a cell rows with equal keys are compared once and then paired. The groups cut, at most one
    for so many rows, are listed when the join is built. Rows are dealt by their hash: those alike in all columns stay together.
    """
    n, m = (df.groupBy(*by).agg(F.count(F.lit(1)).alias(c)) for df, c in ((left, "__n"), (right, "__m")))
    # Without a key all rows are one group. A constant in its place would be optimised away, and with it the cells' partitioning.
    beside = lambda a, b, how="inner": a.join(b, by, how) if by else a.crossJoin(b)
    met = beside(n, m).where((F.col("__n") > lefts) | (F.col("__m") > rights))
    parts = met.select(*by, F.ceil(F.col("__n") / lefts).cast("int").alias("__parts"), F.ceil(F.col("__m") / rights).cast("int").alias("__across")).collect()
    if not parts:
        return beside(left, right).where(condition).drop(*by)
    spark = left.sparkSession
    cells = [r["__parts"] * r["__across"] for r in parts]
    shape = left.select(*by, *(F.lit(1).alias(c) for c in ("__parts", "__across")), F.lit(1).cast("long").alias("__first")).schema
    listed = F.broadcast(spark.createDataFrame([(*r, sum(cells[:i])) for i, r in enumerate(parts)], shape))
    tasks = min(TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(cells)))
    number = F.coalesce(F.col("__first") + F.col("__row") * F.col("__across") + F.col("__column"), F.xxhash64(*by) if by else F.lit(0))
    cell = ["__task", *by, "__row", "__column"]

    def dealt(df: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        hashed = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
        part = F.pmod(F.xxhash64(*hashed), F.coalesce(of, F.lit(1))).cast("int")
        out = beside(df, listed, "left").withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)))
        out = out.withColumn("__task", F.pmod(number, F.lit(tasks)).cast("int"))
        return out.drop("__parts", "__across", "__first").repartitionById(tasks, "__task")

    a, of_left = _classes(dealt(left, "__row", "__parts", "__column", "__across"), cell, left_keys, "__left")
    b, of_right = _classes(dealt(right, "__column", "__across", "__row", "__parts"), cell, right_keys, "__right")
    found = a.join(b.hint("shuffle_hash"), cell).where(condition)
    found = found.withColumn("__left", F.explode("__left")).withColumn("__right", F.explode("__right"))
    return found.select(*of_left, *of_right)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, left_keys: list[str], right_keys: list[str], lefts: int = LEFTS, rights: int = RIGHTS) -> DataFrame:
    """Pairs for which any condition on the sides' keys holds: all keys are compared, in cells that tasks share out."""
    return cell_join(left, right, [], condition, left_keys, right_keys, lefts, rights)


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float, lefts: int = LEFTS, rights: int = RIGHTS) -> DataFrame:
    """Rows where ``low <= point <= high`` (numbers), by bins instead of a nested loop.

    Bins come in levels, each STEP times as wide as the one below, from ``width`` on. A range is listed at the
    first level whose bins are as long as it, where it touches two or three; a point is listed once at
    each level that some range uses, so each pair meets once and no range of any length, endless ones included, has more than
    three rows. The levels in use, at most LEVELS + 1 numbers, are asked for when the join is built. Bins with very many rows are
    cut into cells. ``width`` should be about a usual range's length.
    Null points and bounds, and ranges whose bounds are crossed, match nothing; NaN is larger than every number.
    """
    sizes = [float(width) * STEP**n for n in range(LEVELS)]
    place = lambda c, size: F.floor(F.least(F.greatest(F.col(c).cast("double") / size, F.lit(-LAST_BIN)), F.lit(LAST_BIN)))
    length = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.coalesce(*(F.when(length <= size, F.lit(n)) for n, size in enumerate(sizes)), F.lit(LEVELS))
    some = F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high))
    b = ranges.where(some).withColumn("__level", level)
    used = sorted(r["__level"] for r in b.select("__level").distinct().collect()) or [0]
    size = F.get(F.array(*map(F.lit, sizes)), F.col("__level"))
    touched = F.when(F.col("__level") < LEVELS, F.sequence(place(low, size), place(high, size)))
    b = b.withColumn("__bin", F.explode(F.coalesce(touched, F.array(F.lit(0).cast("long")))))
    spots = [F.struct(F.lit(n).alias("level"), (place(point, F.lit(sizes[n])) if n < LEVELS else F.lit(0).cast("long")).alias("bin")) for n in used]
    a = points.where(F.col(point).isNotNull()).withColumn("__spot", F.explode(F.array(*spots)))
    a = a.withColumns({"__level": F.col("__spot.level"), "__bin": F.col("__spot.bin")}).drop("__spot")
    return cell_join(a, b, ["__level", "__bin"], F.col(point).between(F.col(low), F.col(high)), [point], [low, high], lefts, rights)


def seconds_of(df: DataFrame, name: str) -> Column:
    """A time as a number that never falls as the time grows: seconds for dates and timestamps, anything else as it is.

    Times without a zone are counted by their clock, since a cast to an instant goes back where a clock is put forward.
    """
    kind, at = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(at)
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long") * 86_400
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return at


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: dict[str, str], tie: str, slot: float = 3600) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it (null if there is none).

    Both sides are put under each other, cut into slots of time (``slot`` in seconds, or in units of a ``at`` that is a number), and
    in each slot of a key the last right row is carried forward in a sorted pass. A second pass over one row a key and slot
    carries the last right row of earlier slots, so a key with very many rows is sorted in as many tasks as it has slots,
    and a key's pairs are never formed. ``values`` names right columns by output name; of right rows at one time the one with the
    largest ``tie`` counts, of those with equal ties any. Right rows with a null key or time match nothing; left rows with one
    are kept with null values.
    """
    marked = F.struct(*(F.col(v).alias(k) for k, v in values.items()))
    known = F.col(at).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    a = left.select(F.struct("*").alias("__left"), *by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"))
    a = a.withColumn("__right", F.lit(None).cast(right.select(marked.alias("x")).schema["x"].dataType))
    b = right.where(known).select(F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), *by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), marked.alias("__right"))
    both = a.unionByName(b)
    both = both.withColumn("__slot", F.floor(seconds_of(both, "__at") / slot))
    within = W.Window.partitionBy(*by, "__slot").orderBy("__at", "__side", "__tie").rowsBetween(W.Window.unboundedPreceding, 0)
    earlier = W.Window.partitionBy(*by).orderBy("__slot").rowsBetween(W.Window.unboundedPreceding, -1)
    ends = both.groupBy(*by, "__slot").agg(F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__at", "__tie"))).alias("__end"))
    ends = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).where("__before is not null").drop("__end")
    carried = both.withColumn("__last", F.last("__right", ignorenulls=True).over(within)).where("__side = 1")
    found = carried.join(ends, [*by, "__slot"], "left").withColumn("__found", F.coalesce("__last", "__before"))
    return found.select("__left.*", *(F.col(f"__found.{k}").alias(k) for k in values))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before: str, condition: Column | None = None) -> DataFrame:
    """Pairs of one key whose right time is within ``before`` (an interval) up to the left time.

    Both sides are cut into slots of that length as well, so a key with very many rows is dealt over
    its slots: a left row meets the right rows of its own slot and the one before.
    """
    length = F.expr(f"unix_seconds(timestamp '1970-01-01 00:00:00' + interval {before})")
    slot = lambda df, c: F.floor(seconds_of(df, c) / length)
    a = left.withColumn("__slot", F.explode(F.array(slot(left, left_at), slot(left, left_at) - 1)))
    b = right.withColumnRenamed(key, "__key").withColumn("__of", slot(right, right_at))
    within = (F.col(right_at) <= F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - F.expr(f"interval {before}"))
    met = a.join(b, (F.col(key) == F.col("__key")) & (F.col("__slot") == F.col("__of")) & within)
    return (met if condition is None else met.where(condition)).drop("__slot", "__of", "__key")
