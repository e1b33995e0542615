"""Window functions, over rows and over time."""

from __future__ import annotations

from millrace.sql import both

QUERIES, ORACLES = both({
    "win_rank": """SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr,
        CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS rn,
        CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter,
        round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
        FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""",
    "win_lag_lead": """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win_ignore_nulls": (
        """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM {events}""",
        """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM {events}""",
    ),
    "win_rows": """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS smooth FROM {events}""",
    "win_range_interval": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS recent FROM {events}""",
    "win_topk": (
        """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3""",
        """SELECT o_custkey, o_orderkey, o_totalprice FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
    ),
    "win_tumbling": (
        """SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY window(ts, '1 hour'), event_type""",
        """SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2""",
    ),
    "win_sliding": (
        """SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour', '30 minutes')""",
        """SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS start FROM {events}) GROUP BY start""",
    ),
    "win_session": (
        """SELECT user_id, CAST(session_window.start AS TIMESTAMP_NTZ) AS start, CAST(session_window.end AS TIMESTAMP_NTZ) AS stop, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')""",
        """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM numbered GROUP BY user_id, k""",
    ),
})
