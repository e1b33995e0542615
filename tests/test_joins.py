"""The composed joins against plain ones, with nulls, ties and empty sides."""

import random

from pyspark.sql import functions as F

from millrace.operators.joins import asof_join, interval_join, range_join, theta_join


def test_range_join(spark):
    random.seed(4)
    points = [(i, random.choice([None, round(random.uniform(-30, 30), 1)])) for i in range(200)]
    ranges = [(i, a, None if i % 9 == 0 else a + random.choice([-1, 0, 0.5, 12])) for i, a in enumerate(round(random.uniform(-30, 30), 1) for _ in range(80))]
    got = range_join(spark.createDataFrame(points, "p long, x double"), "x", spark.createDataFrame(ranges, "r long, a double, b double"), "a", "b", 4)
    want = sorted((p, r) for p, x in points for r, a, b in ranges if x is not None and b is not None and a <= x <= b)
    assert sorted((r["p"], r["r"]) for r in got.collect()) == want


def test_range_join_takes_ranges_of_any_length(spark):
    """Lengths from 0 to infinity, NaN bounds and points at the far ends; a range is never listed under more than SALTS bins."""
    inf, nan = float("inf"), float("nan")
    points = [-inf, -1e300, -1e9, -3.0, 0.0, 0.5, 7.25, 255.0, 256.0, 1e6, 1e12, 1e300, inf, nan, None]
    ranges = [(-inf, inf), (0.0, inf), (-1e300, 1e300), (0.0, 1e12), (-5e9, 0.5), (255.5, 256.0), (7.25, 7.25), (-3.0, 1000.0), (0.0, nan), (inf, inf), (5.0, 1.0), (None, 3.0)]
    a = spark.createDataFrame(list(enumerate(points)), "p long, x double")
    b = spark.createDataFrame([(n, *r) for n, r in enumerate(ranges)], "r long, a double, b double")
    # NaN is larger than every number, as Spark has it.
    rank = lambda v: (v != v, 0.0 if v != v else v)
    want = sorted((p, r) for p, x in enumerate(points) for r, (lo, hi) in enumerate(ranges) if None not in (x, lo, hi) and rank(lo) <= rank(x) <= rank(hi))
    got = range_join(a, "x", b, "a", "b", 4)
    assert sorted((r["p"], r["r"]) for r in got.collect()) == want
    assert got.columns == ["p", "x", "r", "a", "b"]


def test_range_join_of_whole_numbers_and_empty_sides(spark):
    a = spark.range(-50, 5000).withColumnRenamed("id", "x")
    b = spark.createDataFrame([(0, -(2**63), 2**63 - 1), (1, 10, 10), (2, 40, 4000), (3, 9, 8)], "r long, a long, b long")
    want = {0: 5050, 1: 1, 2: 3961}
    assert {r["r"]: r["count"] for r in range_join(a, "x", b, "a", "b", 16).groupBy("r").count().collect()} == want
    assert range_join(a, "x", b.where("false"), "a", "b", 16).count() == range_join(a.where("false"), "x", b, "a", "b", 16).count() == 0


def test_asof_join_over_slots(spark):
    """Most rows are of one key; slots of several lengths, nulls in keys and times, rows repeated."""
    random.seed(8)
    some = lambda n, p: None if random.random() < p else n
    left = [(i, some(random.choice("aaaaab"), 0.05), some(random.randint(0, 90), 0.05)) for i in range(120)]
    right = [(500 + i, some(random.choice("aaaac"), 0.05), some(random.randint(0, 90), 0.05)) for i in range(30)] * 2
    a, b = spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "rid long, k string, t int")
    want = {}
    for i, k, t in left:
        known = [(u, r) for r, q, u in right if None not in (k, t, q, u) and q == k and u <= t]
        want[i] = max(known)[1] if known else None
    for slot in (3, 17, 3600):
        got = asof_join(a, b, ["k"], "t", {"found": "rid"}, "rid", slot)
        assert {r["id"]: r["found"] for r in got.collect()} == want
        assert got.count() == len(left)
    assert asof_join(a, b.where("false"), ["k"], "t", {"found": "rid"}, "rid").where("found is not null").count() == 0


def test_asof_join_where_a_clock_is_put_forward(spark):
    """Half past two of that night doesn't exist in the session's zone; times without a zone keep their order all the same."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        at = lambda rows, names: spark.createDataFrame(rows, names).withColumn("t", F.col("t").cast("timestamp_ntz"))
        left = at([(1, "a", "2024-03-31 03:05:00")], "id long, k string, t string")
        right = at([(7, "a", "2024-03-31 02:30:00"), (8, "a", "2024-03-31 03:10:00")], "rid long, k string, t string")
        got = asof_join(left, right, ["k"], "t", {"found": "rid"}, "rid", 600)
        assert [r["found"] for r in got.collect()] == [7]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_asof_join(spark):
    random.seed(5)
    left = [(i, random.choice("abc"), random.randint(0, 20)) for i in range(60)]
    right = [(100 + i, random.choice("ab"), random.randint(0, 20)) for i in range(times)]
    got = asof_join(spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "rid long, k string, t int"), ["k"], "t", {"found": "rid"}, "rid")
    for row in got.collect():
        known = [(t, r) for r, k, t in right if k == row["k"] and t <= row["t"]]
        assert row["found"] == (max(known)[1] if known else None)
    assert got.count() == 60


def test_interval_join(spark):
    random.seed(6)
    at = lambda m: F.timestamp_seconds(F.col(m) * 60).cast("timestamp_ntz")
    a = [(random.choice("ab"), i, random.randint(0, 600)) for i in range(50)]
    b = [(random.choice("abz"), i, random.randint(0, 600)) for i in range(50)]
    left = spark.createDataFrame(a, "k string, i long, m long").withColumn("t", at("m")).drop("m")
    right = spark.createDataFrame(b, "k string, j long, m long").withColumn("u", at("m")).drop("m")
    got = interval_join(left, right, "k", "t", "u", "2 hours")
    want = sorted((i, j) for k, i, t in a for q, j, u in b if k == q and t - 120 <= u <= t)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert interval_join(left, right.where("false"), "k", "t", "u", "2 hours").count() == 0


def test_range_join_cuts_crowded_bins_into_cells(spark):
    """Every bin and the endless level are cut on both sides; nulls beside the keys, equal keys, rows repeated."""
    random.seed(9)
    points = [(i, None if i % 7 == 0 else f"p{i % 5}", random.choice([None, round(random.uniform(-9, 9), 1), float("inf")])) for i in range(300)] * 2
    ranges = [(i if i % 6 else None, a, a + random.choice([0, 0.5, 3, 40, float("inf")])) for i, a in enumerate(round(random.uniform(-9, 9)) * 1.0 for _ in range(90))]
    a, b = spark.createDataFrame(points, "p long, s string, x double"), spark.createDataFrame(ranges, "r long, a double, b double")
    for lefts, rights in ((10, 7), (1, 1000), (1000, 3)):
        got = range_join(a, "x", b, "a", "b", 4, lefts, rights)
        assert got.columns == ["p", "s", "x", "r", "a", "b"]
        want = sorted(repr((*p, *r)) for p in points for r in ranges if p[2] is not None and r[1] <= p[2] <= r[2])
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_range_join_of_one_crowded_bin_is_shared_out(spark):
    """The bin's points stand in one file, as a table's single row group does."""
    a = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("p"), (F.col("id") % 8).alias("x"))
    got = range_join(a, "x", spark.createDataFrame([(0, 1, 2), (1, 3, 3)], "r long, a long, b long"), "a", "b", 10)
    assert got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 1
    assert {r["r"]: r["count"] for r in got.groupBy("r").count().collect()} == {0: 10_000, 1: 5_000}


def test_cells_are_dealt_to_tasks_in_turn(spark):
    """Three bins of 800 points and 80 ranges, each in four by five cells: 60 tasks, and none without a cell; rows of bins that aren't cut come along."""
    points = spark.range(0, 2400).select(F.col("id").alias("p"), (F.col("id") % 24).alias("x")).union(spark.createDataFrame([(9000, 500)], "p long, x long"))
    ranges = spark.range(0, 240).select(F.col("id").alias("r"), (F.col("id") % 3 * 8).alias("a"), (F.col("id") % 3 * 8 + 7).alias("b")).union(spark.createDataFrame([(9000, 500, 501)], "r long, a long, b long"))
    got = range_join(points, "x", ranges, "a", "b", 8, 200, 16)
    rows = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(rows) == 60 and all(rows)
    assert sum(rows) == 3 * 800 * 80 + 1
    assert got.distinct().count() == sum(rows)


def test_theta_join_in_cells(spark):
    """All pairs are compared, cut into cells or not, whatever the condition; null keys match as the condition says."""
    random.seed(10)
    left = [(i, random.choice([None, 1, 2, 5, 9])) for i in range(90)]
    right = [(i, random.choice([None, 0, 3, 7])) for i in range(50)]
    a, b = spark.createDataFrame(left, "i long, x long"), spark.createDataFrame(right, "j long, y long")
    for cut in ((8, 7), (1000, 1000)):
        got = theta_join(a, b, F.col("x") < F.col("y"), ["x"], ["y"], *cut)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, x in left for j, y in right if None not in (x, y) and x < y)
        either = theta_join(a, b, F.coalesce(F.col("x") < F.col("y"), F.lit(True)), ["x"], ["y"], *cut)
        assert sorted((r["i"], r["j"]) for r in either.collect()) == sorted((i, j) for i, x in left for j, y in right if None in (x, y) or x < y)


def _many_parts(tmp_path, times):
    """The part table so many times over, in one file of one row group."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    one = pq.read_table("/root/testdata/sf0.01/part.parquet")
    copies = [one.set_column(0, one.schema.field(0), pc.add(one.column(0), i * one.num_rows)) for i in range(times)]
    pq.write_table(pa.concat_tables(copies), tmp_path / "part.parquet")


def _shared_out(spark, tmp_path, name, times):
    from millrace.plans import ORACLES, QUERIES

    _many_parts(tmp_path, times)
    got, con = QUERIES[name](spark, str(tmp_path)), __import__("duckdb").connect()
    assert got.rdd.getNumPartitions() > 1
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    sums = lambda a, b: f"count(*), sum({a}), sum({b}), sum(({a} % 1009) * ({b} % 1013))"
    a, b = got.columns
    want = con.execute(f"select {sums(a, b)} from ({ORACLES[name]})").fetchone()
    assert tuple(int(x) for x in got.selectExpr(*sums(a, b).split(", ")).first()) == tuple(int(x) for x in want)


def test_join_range_is_shared_out(spark, tmp_path):
    _shared_out(spark, tmp_path, "join_range", 40)


def test_join_theta_is_shared_out(spark, tmp_path):
    _shared_out(spark, tmp_path, "join_theta", 100)
