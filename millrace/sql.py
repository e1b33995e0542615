"""Queries written in SQL: tables are named in braces and read from the folder that a query is given."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]


def query(text: str) -> Query:
    """A query that runs ``text`` over the tables named in braces; no view is registered."""
    names = [n for n in TABLES if re.search(rf"\{{{n}\}}", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    return run


def plain(text: str) -> str:
    """The same SQL with the tables' bare names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def both(pairs: dict[str, str | tuple[str, str]]) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and their SQL for the other engine: one text where both read it alike, else one for each."""
    texts = {k: (v, v) if isinstance(v, str) else v for k, v in pairs.items()}
    return {k: query(a) for k, (a, _) in texts.items()}, {k: plain(b) for k, (_, b) in texts.items()}
