"""Projections, filters, joins, sorts, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import asof_join, interval_join, range_join, theta_join
from millrace.sql import both
from millrace.session import table

QUERIES, ORACLES = both({
    "project_expr": """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM {lineitem}""",
    "filter_conj": """SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} WHERE l_quantity > 40 AND l_shipdate < TIMESTAMP_NTZ'1998-01-01 00:00:00' AND l_discount <= 0.05""",
    "filter_disj": """SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} WHERE (l_quantity > 48 OR l_discount > 0.09) AND NOT (l_returnflag = 'R')""",
    "filter_between_in": """SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "filter_like_regex": (
        r"""SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type RLIKE '^(PROMO|SMALL)'""",
        r"""SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND regexp_matches(p_type, '^(PROMO|SMALL)')""",
    ),
    "case_when": """SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band FROM {events}""",
    "null_logic": (
        """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, nullif(o_orderstatus, 'F') <=> nullif(o_orderstatus, 'O') AS same FROM {orders}""",
        """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderstatus, 'O') AS same FROM {orders}""",
    ),
    "cast_decimal": """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM {lineitem} GROUP BY l_returnflag""",
    "join_inner_broadcast": """SELECT s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey""",
    "join_inner_merge": (
        """SELECT /*+ MERGE(o) */ o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
        """SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
    ),
    "join_shuffle_hash": (
        """SELECT /*+ SHUFFLE_HASH(o) */ o_orderstatus, l_returnflag, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderstatus, l_returnflag""",
        """SELECT o_orderstatus, l_returnflag, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderstatus, l_returnflag""",
    ),
    "join_left": """SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY c_custkey""",
    "join_right": """SELECT c_custkey, c_mktsegment, o_orderkey FROM (SELECT * FROM {customer} WHERE c_acctbal > 5000) c RIGHT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 300000) o ON c_custkey = o_custkey""",
    "join_full": """SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey""",
    "join_semi": (
        """SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey""",
        """SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    ),
    "join_anti": (
        """SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey""",
        """SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    ),
    # A null on the right leaves nothing, one on the left leaves out its row unless the list is empty.
    "join_null_aware_anti": """
        SELECT 'null listed' AS kind, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM {supplier} WHERE s_nationkey < 12 OR s_nationkey = 3)
            AND EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = 3)
        UNION ALL SELECT 'none listed', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM {supplier} WHERE s_nationkey < 12 AND s_nationkey <> 3)
        UNION ALL SELECT 'null asked', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM {nation} WHERE nullif(n_nationkey, 24) NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_nationkey < 12)
        UNION ALL SELECT 'empty list', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM {nation} WHERE nullif(n_nationkey, 24) NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_nationkey < 0)""",
    "join_cross": """SELECT r_name, n_name FROM {region} CROSS JOIN {nation}""",
    "join_star": """SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS price
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""",
    "join_lateral": """SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM {customer} WHERE c_acctbal > 9000) c,
        LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
    "sort_limit": """SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
    "sort_nulls": """SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} ORDER BY status ASC NULLS LAST, o_orderkey LIMIT 30""",
    "limit_offset": """SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 40""",
    "set_union": """SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}""",
    "set_union_all": """SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}) u GROUP BY k""",
    "set_intersect": """SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000""",
    "set_intersect_all": """SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}""",
    "set_except": """SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000""",
    "set_except_all": """SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}""",
    "subq_scalar_corr": """SELECT o_orderkey FROM {orders} o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)""",
    "subq_exists": """SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 300000)""",
    # Each region's nations are walked in the order of their keys, with the customers met so far.
    "cte_recursive": """WITH RECURSIVE met AS (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY c_nationkey),
        walk AS (SELECT n_regionkey, n_nationkey, coalesce(n, 0) AS n, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS earlier FROM {nation} LEFT JOIN met ON n_nationkey = c_nationkey),
        steps(region, nation, depth, customers) AS (SELECT n_regionkey, n_nationkey, 1, n FROM walk WHERE earlier IS NULL
            UNION ALL SELECT region, n_nationkey, depth + 1, customers + n FROM steps JOIN walk ON earlier = nation AND n_regionkey = region)
        SELECT r_name, nation, depth, customers FROM steps JOIN {region} ON region = r_regionkey""",
})
ORACLES["filter_conj"] = ORACLES["filter_conj"].replace("TIMESTAMP_NTZ", "TIMESTAMP ")


def _near_small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    few = part.where("p_size = 1").select(F.col("p_partkey").alias("near"), (F.col("p_retailprice") - 5).alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    return part.select("p_partkey", "p_retailprice"), few


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts priced within five of a small part, by a plain condition: all prices are compared."""
    part, few = _near_small(spark, sf_dir)
    return theta_join(part, few, F.col("p_retailprice").between(F.col("low"), F.col("high")), ["p_retailprice"], ["low", "high"]).select("p_partkey", "near")


def join_range_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by bins."""
    part, few = _near_small(spark, sf_dir)
    return range_join(part, "p_retailprice", few, "low", "high", 10).select("p_partkey", "near")


def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts cheaper, by more than three, than small ones."""
    part = table(spark, sf_dir, "part")
    a = part.where("p_size > 48").select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("price"))
    b = part.where("p_size < 3").select(F.col("p_partkey").alias("b"), (F.col("p_retailprice") - 3).alias("below"))
    return theta_join(a, b, F.col("price") < F.col("below"), ["price"], ["below"]).select("a", "b")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view at or before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return asof_join(bought, seen, ["user_id"], "ts", {"view_id": "event_id"}, "event_id").select("event_id", "user_id", "view_id")


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views of their user in the six hours before."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at"))
    seen = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen_at"))
    return interval_join(bought, seen, "user_id", "bought_at", "seen_at", "6 hours").select("user_id", "purchase_id", "view_id")


_RANGE = """SELECT a.p_partkey, b.p_partkey AS near FROM part a JOIN part b
ON b.p_size = 1 AND a.p_retailprice BETWEEN b.p_retailprice - 5 AND b.p_retailprice + 5"""
QUERIES |= {"join_theta": join_theta, "join_range": join_range, "join_range_binned": join_range_binned, "join_asof": join_asof, "join_interval": join_interval}
ORACLES |= {
    "join_theta": """SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT * FROM part WHERE p_size > 48) a JOIN (SELECT * FROM part WHERE p_size < 3) b ON a.p_retailprice < b.p_retailprice - 3""",
    "join_range": _RANGE,
    "join_range_binned": _RANGE,
    "join_asof": """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "join_interval": """SELECT p.user_id, p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v
ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
}
