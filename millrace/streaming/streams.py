"""Structured Streaming queries: each runs until its input is used up and returns what its sink has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.session import table
from millrace.sources.scratch import scratch_path

#: Seconds after which a query that does not end is stopped.
LIMIT = 600
#: Micro-batches that a replayed table arrives in.
BATCHES = 3
#: Files of a replayed micro-batch, one or more tasks each; for large tables as many as tasks should write and read a batch.
FILES = 4


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream; event times get a zone, which watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    # A table is a file or a folder of files: a pattern takes either.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(events: DataFrame, parts: list[Column], name: str, options: dict[str, str] | None = None, files: int = FILES) -> DataFrame:
    """A table as a stream that arrives in as many micro-batches as there are conditions in ``parts``, in their order.

    Each part is ``files`` files in a folder of its own, written after the one before: the source goes by the times of files and takes
    so many a batch. A part with too few rows for all its files is filled up with files without rows.
    """
    spark, path = events.sparkSession, scratch_path(events.sparkSession, name)
    for n, part in enumerate(parts):
        folder = f"{path}/part={n}"
        events.where(part).repartition(files).write.parquet(folder)
        for _ in range(files - len(spark.read.schema(events.schema).parquet(folder).inputFiles())):
            events.where("false").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).options(**options or {}).parquet(path)
    return stream.drop("part").withColumn("ts", F.col("ts").cast("timestamp"))


def event_batches(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``events`` replayed by time in BATCHES micro-batches; in a batch they come in no order."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    if low is None:
        return event_stream(spark, sf_dir)
    slot = F.least(F.lit(BATCHES - 1), F.floor((at - low) * BATCHES / F.lit(high - low + 1))).cast("int")
    return replayed(events, [slot == n for n in range(BATCHES)], name)


def _finish(query) -> None:
    if not query.awaitTermination(LIMIT):
        query.stop()
        raise TimeoutError(f"the stream did not end in {LIMIT} seconds")


def to_files(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to Parquet files and read them."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    _finish(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(path)


def to_batches(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Write each micro-batch of a stream to a folder of its own; the last one written is returned."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        if last and batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    _finish(stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def stream_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_files(event_stream(spark, sf_dir).select("event_id", "event_type", "value"), "file_source")


def sink_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory sink is for small results only: here one row a kind of event."""
    name = f"sink_memory_{scratch_path(spark, 'm').rpartition('-')[2]}"
    counts = event_batches(spark, sf_dir, "memory_events").groupBy("event_type").count()
    _finish(counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start())
    return spark.table(name)


def sink_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_batches(event_batches(spark, sf_dir, "foreach_events").groupBy("user_id").count(), "foreach_batch", "complete")


def _hours(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_batches(_flat(_hours(event_batches(spark, sf_dir, "complete_events"))), "tumbling_complete", "complete")


def closed_hours(events: DataFrame) -> DataFrame:
    """Hours that a watermark of one hour has closed; events that come after it are dropped."""
    return to_files(_flat(_hours(events.withWatermark("ts", "1 hour"))), "tumbling_append")


def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a watermark of one hour has closed; those still open at the end are not given."""
    return closed_hours(event_batches(spark, sf_dir, "append_events"))


def closed_sessions(events: DataFrame) -> DataFrame:
    """Sessions of users, closed by a watermark of one hour."""
    sessions = events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return to_files(sessions.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "session")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_sessions(event_batches(spark, sf_dir, "session_events"))


def first_seen(events: DataFrame, delay: str) -> DataFrame:
    """The first event of each user and kind; one seen again more than ``delay`` after counts as new, and events later than the watermark are dropped."""
    kept = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return to_files(kept.select("user_id", "event_type"), "dedup")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind, over several batches; the watermark is longer than the table, so that SQL knows the answer."""
    return first_seen(event_batches(spark, sf_dir, "dedup_events"), "60 days")


def bought_after_seen(events: DataFrame) -> DataFrame:
    """Purchases with the views of their user in the six hours before, both sides streamed. Events over an hour late are dropped, and a view's state with the last purchase that may ask for it."""
    bought = events.where("event_type = 'purchase'").select(F.col("user_id"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at")).withWatermark("bought_at", "1 hour")
    seen = events.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("seen_at")).withWatermark("seen_at", "1 hour")
    within = F.expr("user_id = viewer and seen_at <= bought_at and seen_at >= bought_at - interval 6 hours")
    return to_files(bought.join(seen, within).select("user_id", "purchase_id", "view_id"), "stream_join")


def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views of their user in the six hours before, over several batches."""
    return bought_after_seen(event_batches(spark, sf_dir, "join_events"))


STORE = "spark.sql.streaming.stateStore.providerClass"


class RunningSum(StatefulProcessor):
    """Count and sum of a key's values over all batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.sums.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    def close(self) -> None:
        pass


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count and sum of each user, kept as state of our own in RocksDB; each batch gives the users it changed."""
    events = event_batches(spark, sf_dir, "state_events").select("user_id", "value")
    kept = events.groupBy("user_id").transformWithStateInPandas(RunningSum(), "user_id long, n long, total double", "Update", "None")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = to_batches_all(kept, "state")
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    newest = F.max_by(F.struct("n", "total"), "n").alias("s")
    return batches.groupBy("user_id").agg(newest).select("user_id", "s.n", "s.total")


def to_batches_all(stream: DataFrame, name: str) -> DataFrame:
    """All micro-batches of a stream in update mode."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _finish(stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(path)


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    stream_file_source, sink_memory, sink_foreach_batch, stream_tumbling_complete, stream_tumbling_append,
    stream_session, stream_dedup, stream_stream_join, stream_state,
)
QUERIES = {f.__name__: f for f in _ALL}
_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES = {
    "stream_file_source": "SELECT event_id, event_type, value FROM events",
    "sink_memory": "SELECT event_type, count(*) AS count FROM events GROUP BY event_type",
    "sink_foreach_batch": "SELECT user_id, count(*) AS count FROM events GROUP BY user_id",
    "stream_tumbling_complete": _HOURS,
    "stream_tumbling_append": f"SELECT * FROM ({_HOURS}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_session": """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_stream_join": """SELECT p.user_id, p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v
ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "stream_state": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id",
}
