"""Operator 2, URL filters: host and path rules, then a blocked Bloom filter backed by an exact join.

Everything here is DataFrame code. A listed URL is found in two steps: a split-block
Bloom filter (512-bit blocks of eight words, one bit a word) lets almost only listed URLs through,
and a join on the whole canonical URL removes the false positives. URLs that the Bloom filter
turns away are never shuffled.

The filter's blocks are broadcast only while their size, known from the count of listed URLs,
stays under ``max_broadcast_bytes``; beyond it they are joined by block number.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
never listed (allow). A rule with an empty path fits every path. Repeated rows are judged one by
one. An empty list allows whatever no rule fits. Columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

#: The rules of the query: (verdict, host, path prefix).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Query parameters that do not name another page. Fixed values.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
WORDS = 8  # 64-bit words in a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default ports, path without closing slashes, sorted query without tracking.

    Null where the URL is null or has no ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    if not fits:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """The bit of ``key`` in a block's word: six bits of a second hash choose it."""
    bit = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row a block that any key falls into: its number and its eight words."""
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(
        *(F.bit_or(_mask(F.col(key), i)).alias(f"w{i}") for i in range(WORDS))
    )


def filter_urls(
    pages: DataFrame,
    listed_urls: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_key: int = 16,
    max_broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """Judge every row of ``pages``: the longest rule that fits decides, else block what is listed.

    ``listed_urls`` has one column ``url``. Returns the id, ``host``, ``path``, ``rule``,
    ``verdict`` and ``canonical_url``.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url_filter")
    listed = scratch.write(
        listed_urls.select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct(), "listed"
    )
    blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    bloom = bloom_blocks(listed, "listed_url", blocks)
    if blocks * (WORDS + 1) * 16 <= max_broadcast_bytes:
        bloom = F.broadcast(bloom)

    url = F.col(url_col)
    judged = (
        pages.select(F.col(id_col), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"), canonical(url).alias("canonical_url"))
        .withColumn("__fit", rule_of(F.col("host"), F.col("path"), rules))
        # Rows that a rule settles and those without a URL look nowhere: numbers that no block has keep them apart.
        .withColumn("block", F.when(F.col("__fit").isNull() & F.col("canonical_url").isNotNull(), _block(F.col("canonical_url"), blocks)).otherwise(-1 - F.pmod(F.xxhash64(id_col), F.lit(4096))))
    )
    in_bloom = reduce(lambda a, b: a & b, [(F.col(f"w{i}").bitwiseAND(_mask(F.col("canonical_url"), i)) != 0) for i in range(WORDS)])
    probed = judged.join(bloom, "block", "left").select(
        id_col, "host", "path", F.col("__fit.rule").alias("rule"), F.col("__fit.verdict").alias("__verdict"), "canonical_url",
        (F.col("__fit").isNull() & F.col("canonical_url").isNotNull() & F.coalesce(in_bloom, F.lit(False))).alias("__maybe"),
    )
    out = [id_col, "host", "path", "rule", "verdict", "canonical_url"]
    passed = probed.where(~F.col("__maybe")).withColumn("verdict", F.coalesce("__verdict", F.lit("allow"))).select(*out)
    checked = (
        probed.where("__maybe")
        .join(listed, F.col("canonical_url") == F.col("listed_url"), "left")
        .withColumn("verdict", F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow"))
        .select(*out)
    )
    return passed.unionAll(checked)


#: Host labels whose pages make up the list of the query: the tables come without one.
LISTED_LABELS = ("spam-farm", "cheap-pills")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the four rules, then by the list of pages on hosts known for spam."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")).select("url")
    return filter_urls(pages, listed)


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS query
  FROM parts
), named AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN
           regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical_url
  FROM split
), listed AS (
  SELECT DISTINCT canonical_url AS u FROM named
  WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND canonical_url IS NOT NULL
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       canonical_url
FROM ruled LEFT JOIN listed ON canonical_url = u
"""
