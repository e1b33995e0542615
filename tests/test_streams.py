"""Streams whose events come late and out of order, in several micro-batches."""

from pyspark.sql import functions as F

from millrace.streaming.streams import bought_after_seen, closed_hours, closed_sessions, event_batches, first_seen, replayed

#: (batch, minute, user). The watermark is one hour behind the latest minute so far; a batch drops what was late for the batch before it.
EVENTS = [
    (0, 10, 1), (0, 65, 1), (0, 20, 2), (0, 5, 1),
    (1, 30, 1), (1, 200, 1), (1, 70, 2),
    (2, 100, 2), (2, 150, 2), (2, 10, 1), (2, 190, 1),
    (3, 600, 3), (3, 20, 1), (3, 145, 2),
]


def events(spark):
    rows = spark.createDataFrame([(n, 1_700_000_400 // 3600 * 3600 + m * 60, u) for n, (b, m, u) in enumerate(EVENTS)], "event_id long, s long, user_id long")
    at = F.timestamp_seconds("s")
    table = rows.select("event_id", at.cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"))
    parts = [F.col("event_id").isin([n for n, e in enumerate(EVENTS) if e[0] == b]) for b in range(4)]
    return replayed(table, parts, "test_streams")


def in_time():
    """The events whose hour is open when their batch comes, and the latest minute."""
    kept = []
    for b in range(4):
        late = max([m for n, m, _ in EVENTS if n < b - 1], default=0) - 60
        kept += [e for e in EVENTS if e[0] == b and (e[1] // 60 + 1) * 60 > late]
    return kept, max(m for _, m, _ in EVENTS)


def test_late_rows_are_dropped_and_others_counted(spark):
    got = sorted(r["n"] for r in closed_hours(events(spark)).collect())
    kept, latest = in_time()
    hours = {}
    for _, m, _ in kept:
        hours[m // 60] = hours.get(m // 60, 0) + 1
    assert len(kept) == len(EVENTS) - 1
    assert got == sorted(n for h, n in hours.items() if (h + 1) * 60 <= latest - 60)


def test_sessions_over_batches(spark):
    """User 1's events of minutes 5, 10, 30 and 10 come in three batches and are one session; the late one of minute 20 is dropped."""
    got = sorted((r["user_id"], r["n"]) for r in closed_sessions(events(spark)).collect())
    assert got == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 2)]


def stream_of(spark, rows, batches):
    """(batch, minute, user, kind) as a stream; an event's id is its place in the list."""
    frame = spark.createDataFrame([(n, 1_700_000_400 // 3600 * 3600 + m * 60, u, k) for n, (_, m, u, k) in enumerate(rows)], "event_id long, s long, user_id long, event_type string")
    table = frame.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    return replayed(table, [F.col("event_id").isin([n for n, r in enumerate(rows) if r[0] == b]) for b in range(batches)], "test_streams")


def test_dedup_forgets_what_the_watermark_has_passed(spark):
    """User 1's view of minute 0 is forgotten once the watermark passes minute 60; of user 2 all come in time, user 3's late one is dropped."""
    rows = [(0, 0, 1, "view"), (0, 5, 2, "view"), (1, 30, 1, "view"), (1, 20, 2, "view"), (1, 300, 4, "view"), (2, 310, 4, "view"), (2, 320, 5, "view"), (3, 10, 3, "view"), (3, 330, 1, "view")]
    got = sorted(r["user_id"] for r in first_seen(stream_of(spark, rows, 4), "1 hour").collect())
    assert got == [1, 1, 2, 4, 5]


def test_join_over_batches_with_late_rows(spark):
    """A view that comes a batch after its purchase still meets it; one that the watermark has passed meets nothing."""
    rows = [
        (0, 0, 1, "view"), (0, 30, 1, "purchase"), (0, 10, 2, "purchase"),
        (1, 20, 1, "view"), (1, 900, 9, "view"), (1, 900, 9, "purchase"),
        (2, 905, 9, "purchase"), (2, 901, 9, "view"),
        (3, 5, 2, "view"), (3, 25, 1, "purchase"), (3, 910, 9, "purchase"),
    ]
    got = sorted((r["purchase_id"], r["view_id"]) for r in bought_after_seen(stream_of(spark, rows, 4)).collect())
    assert got == [(1, 0), (1, 3), (5, 4), (6, 4), (6, 7), (10, 4), (10, 7)]


def test_batches_have_all_their_files(spark, tmp_path):
    """Every micro-batch reads several files, and together they hold each row once."""
    seen = []

    def put(batch, number):
        files = batch.select(F.input_file_name().alias("f")).distinct().count()
        seen.append((files, sorted(r["event_id"] for r in batch.select("event_id").collect())))

    stream = event_batches(spark, "/root/testdata/sf0.001", "test_files")
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = sorted(r["event_id"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect())
    assert len(seen) == 3 and all(files > 1 for files, _ in seen)
    assert sorted(n for _, ids in seen for n in ids) == want
