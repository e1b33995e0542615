"""Scalar functions on strings, dates, numbers, arrays, maps, structs and JSON."""

from __future__ import annotations

from millrace.sql import both

QUERIES, ORACLES = both({
    "str_basic": (
        """SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes, split_part(text, ' ', 1) AS word, concat_ws('-', lang, source) AS tag FROM {documents}""",
        """SELECT doc_id, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, split_part(text, ' ', 1) AS word, concat_ws('-', lang, source) AS tag FROM {documents}""",
    ),
    "str_case": """SELECT doc_id, lower(text) AS low, upper(lang) AS up, trim(lpad(lang, 5, ' ')) AS t FROM {documents}""",
    "str_regex": (
        r"""SELECT doc_id, regexp_replace(text, '[0-9]+', '#') AS masked, CAST(size(split(text, '[ ]')) AS BIGINT) AS parts FROM {documents}""",
        r"""SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, len(regexp_split_to_array(text, '[ ]')) AS parts FROM {documents}""",
    ),
    "str_distance": """SELECT p_partkey, CAST(levenshtein(p_type, 'PROMO') AS BIGINT) AS d FROM {part}""",
    "url_parse": (
        """SELECT page_id, parse_url(url, 'HOST') AS host, parse_url(url, 'PATH') AS path, parse_url(url, 'QUERY') AS query FROM {pages}""",
        r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM {pages}""",
    ),
    "date_trunc": (
        """SELECT CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS month, count(*) AS n FROM {orders} GROUP BY 1""",
        """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM {orders} GROUP BY 1""",
    ),
    "date_parts": (
        """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, CAST(dayofweek(o_orderdate) AS BIGINT) AS d, CAST(datediff(DATE'2002-01-01', o_orderdate) AS BIGINT) AS age FROM {orders}""",
        """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS d, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age FROM {orders}""",
    ),
    "math_basic": (
        """SELECT o_orderkey, round(o_totalprice / 7, 4) AS q, CAST(o_orderkey % 7 AS BIGINT) AS r, CAST(o_orderkey DIV 7 AS BIGINT) AS i, abs(5 - o_orderkey % 11) AS a FROM {orders}""",
        """SELECT o_orderkey, round(o_totalprice / 7, 4) AS q, CAST(o_orderkey % 7 AS BIGINT) AS r, CAST(o_orderkey // 7 AS BIGINT) AS i, abs(5 - o_orderkey % 11) AS a FROM {orders}""",
    ),
    "math_log_pow": """SELECT p_partkey, round(ln(p_retailprice), 8) AS l, round(log10(p_retailprice), 8) AS g, round(power(p_size, 1.5), 6) AS p, round(sqrt(p_retailprice), 8) AS s FROM {part}""",
    "math_try": (
        """SELECT p_partkey, round(try_divide(p_retailprice, p_size - 25), 6) AS q FROM {part}""",
        """SELECT p_partkey, round(p_retailprice / nullif(p_size - 25, 0), 6) AS q FROM {part}""",
    ),
    "arr_hof": (
        """SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 5) AS norm,
        CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS above FROM {embeddings}""",
        """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm,
        len(list_filter(embedding, lambda x: x > 0)) AS above FROM {embeddings}""",
    ),
    "arr_explode": (
        r"""SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM {documents}) GROUP BY doc_id""",
        r"""SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) GROUP BY doc_id""",
    ),
    "map_basic": (
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type),
        m AS (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM c GROUP BY user_id)
        SELECT user_id, array_join(sort_array(map_keys(m)), ',') AS kinds, try_element_at(m, 'purchase') AS bought, CAST(size(m) AS BIGINT) AS entries, kind, n FROM m LATERAL VIEW explode(m) e AS kind, n""",
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type),
        m AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, max(n) FILTER (WHERE event_type = 'purchase') AS bought, count(*) AS entries FROM c GROUP BY user_id)
        SELECT user_id, kinds, bought, entries, event_type AS kind, n FROM m JOIN c USING (user_id)""",
    ),
    "struct_basic": (
        """SELECT event_id, s.kind AS kind, s.v.value AS value FROM (SELECT event_id, named_struct('kind', event_type, 'v', named_struct('value', value)) AS s FROM {events})""",
        """SELECT event_id, event_type AS kind, value FROM {events}""",
    ),
    "json_extract": (
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, variant_get(parse_json(props), '$.k', 'bigint') AS v FROM {events}""",
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM {events}""",
    ),
})
