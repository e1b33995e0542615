"""Scans and round trips through file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table
from millrace.sources.scratch import scratch_path

#: Keeps microseconds, which the default drops.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the rows that a pushed filter leaves."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


def _round_trip(spark: SparkSession, df: DataFrame, kind: str, **options: str) -> DataFrame:
    path = scratch_path(spark, kind)
    df.write.format(kind).options(**options).save(path)
    return spark.read.format(kind).schema(df.schema).options(**options).load(path)


def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "nation"), "csv", header="true")


def scan_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "events"), "json", **TIMES)


def scan_orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "part"), "orc")


def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders partitioned by status; only one partition is read back."""
    path = scratch_path(spark, "partitioned")
    # No shuffle: there are few statuses, so each task writes a file of each, and no status is left to one task.
    orders = table(spark, sf_dir, "orders")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(orders.schema).parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")


QUERIES = {f.__name__: f for f in (scan_parquet, scan_csv_roundtrip, scan_json_roundtrip, scan_orc_roundtrip, partitioned_write)}
ORACLES = {
    "scan_parquet": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "scan_csv_roundtrip": "SELECT * FROM nation",
    "scan_json_roundtrip": "SELECT * FROM events",
    "scan_orc_roundtrip": "SELECT * FROM part",
    "partitioned_write": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
}
