"""Functions written in Python: scalar, grouped and table-valued."""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import table

SPACE = re.compile("[ \\t\\n\\r]+")
#: Rows of a key that a grouped function gets at a time, about.
GROUP_ROWS = 100_000


@F.udf(T.StringType())
def initials(text: str | None) -> str | None:
    return None if text is None else "".join(w[0] for w in text.split(" ") if w)


@F.pandas_udf(T.DoubleType())
def damped(values: pd.Series) -> pd.Series:
    return values / (1 + values.abs())


@F.arrow_udf(T.LongType())
def size_of(text: pa.Array) -> pa.Array:
    return pc.utf8_length(text).cast(pa.int64())


@F.pandas_udf(T.DoubleType())
def spread(values: pd.Series) -> float:
    return float(values.max() - values.min())


@F.udtf(returnType=T.StructType().add("word", T.StringType()).add("at", T.IntegerType()))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str | None) -> Iterator[tuple[str, int]]:
        for at, word in enumerate(filter(None, SPACE.split(text or ""))):
            yield word, at


def udf_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", initials(F.col("p_name")).alias("initials"))


def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(damped(F.col("value")), 8).alias("damped"))


def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", size_of(F.col("text")).alias("chars"))


def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(spread(F.col("value")), 6).alias("spread"))


def udtf_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.lateralJoin(Words(F.col("text").outer())).select("doc_id", "word", "at")


def apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events with their share of the user's sum. Sums are made before, so a user's events come in groups of bounded size."""

    def share(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": group["event_id"], "share": (group["value"] / group["total"]).round(8)})

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    sums = events.groupBy("user_id").agg(F.sum("value").alias("total"), F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("salts"))
    salted = events.join(sums, "user_id").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.col("salts")))
    return salted.groupBy("user_id", "salt").applyInPandas(share, "event_id long, share double")


QUERIES = {f.__name__: f for f in (udf_py, udf_pandas, udf_arrow, udaf_pandas, udtf_py, apply_in_pandas)}
ORACLES = {
    "udf_py": "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: w[1]), '') AS initials FROM part",
    "udf_pandas": "SELECT event_id, round(value / (1 + abs(value)), 8) AS damped FROM events",
    "udf_arrow": "SELECT doc_id, length(text) AS chars FROM documents",
    "udaf_pandas": "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id",
    "udtf_py": r"""SELECT doc_id, word, CAST(n - 1 AS INTEGER) AS "at" FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS n
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS words FROM documents))""",
    "apply_in_pandas": "SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 8) AS share FROM events",
}
