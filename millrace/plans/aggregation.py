"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranks import exact_percentiles
from millrace.sql import both
from millrace.session import table

QUERIES, ORACLES = both({
    "agg_having": """SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY source HAVING count(*) > 10""",
    "agg_distinct": """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus""",
    "agg_filter": """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM {events} GROUP BY user_id""",
    "agg_cube": (
        """SELECT n_regionkey, s_nationkey, CAST(grouping(n_regionkey) AS BIGINT) AS g, count(*) AS n FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, s_nationkey)""",
        """SELECT n_regionkey, s_nationkey, CAST(grouping(n_regionkey) AS BIGINT) AS g, count(*) AS n FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, s_nationkey)""",
    ),
    "agg_rollup": """SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)""",
    "agg_grouping_sets": """SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "agg_stats": """SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c,
        round(covar_samp(value, user_id), 4) AS cs, round(regr_slope(value, user_id), 8) AS slope FROM {events} GROUP BY event_type""",
    "agg_moments": (
        """SELECT event_type, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM {events} GROUP BY event_type""",
        """WITH m AS (SELECT event_type, avg(value) AS mu FROM {events} GROUP BY event_type)
        SELECT e.event_type, round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5), 6) AS skew,
               round(avg(power(value - mu, 4)) / power(avg(power(value - mu, 2)), 2) - 3, 6) AS kurt
        FROM {events} e JOIN m ON e.event_type = m.event_type GROUP BY e.event_type""",
    ),
    "agg_max_by": (
        """SELECT user_id, max_by(event_id, struct(value, event_id)) AS best, min_by(event_id, struct(value, event_id)) AS worst FROM {events} GROUP BY user_id""",
        """SELECT user_id, arg_max(event_id, row(value, event_id)) AS best, arg_min(event_id, row(value, event_id)) AS worst FROM {events} GROUP BY user_id""",
    ),
    "agg_collect": (
        """SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS kinds, count(event_id) AS n FROM {events} GROUP BY user_id""",
        """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(event_id) AS n FROM {events} GROUP BY user_id""",
    ),
    "agg_listagg": (
        """SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey""",
        """SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey""",
    ),
    "agg_histogram": (
        """SELECT CAST(width_bucket(o_totalprice, 0, 500000, 20) AS BIGINT) AS bucket, count(*) AS n FROM {orders} GROUP BY 1""",
        """SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM {orders} GROUP BY 1""",
    ),
    "pivot": (
        """SELECT * FROM (SELECT user_id, event_type, event_id FROM {events}) PIVOT (count(event_id) FOR event_type IN ('click' AS click, 'view' AS view, 'purchase' AS purchase))""",
        """SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view,
               nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchase FROM {events} GROUP BY user_id""",
    ),
    "unpivot": (
        """SELECT l_orderkey, l_linenumber, l_partkey, kind, amount FROM {lineitem} UNPIVOT (amount FOR kind IN (l_quantity, l_discount, l_tax))""",
        """SELECT l_orderkey, l_linenumber, l_partkey, kind, amount FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS kind, l_quantity AS amount FROM {lineitem} UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM {lineitem} UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM {lineitem})""",
    ),
})


def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sums, averages and counts of lineitem by flag and status."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog estimates of customers by status: an engine's own, so without SQL."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


def agg_approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches of prices by flag: an engine's own, so without SQL."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.5, 0.9], 10_000).alias("prices"))


def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of values by kind, without a kind's values in one buffer."""
    found = exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


QUERIES |= {"agg_percentile": agg_percentile, "agg_group": agg_group, "agg_approx_distinct": agg_approx_distinct, "agg_approx_percentile": agg_approx_percentile}
ORACLES["agg_percentile"] = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"
ORACLES["agg_group"] = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus"""
