"""All queries by name, and the SQL that tells the same rows.

A query is built from the package's operators, or, where SQL says it best, is one statement that both engines run: there
``{documents}`` stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that tells its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """Register one statement for both engines (or two that differ in dialect)."""
    names = sorted(set(re.findall(r"\{(\w+)\}", spark_text or text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text or text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = re.sub(r"\{(\w+)\}", r"\1", text)


#: The chunk view in SQL: lines that aren't blank, numbered from 0.
CHUNKS = """
pieces AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents),
chunks AS (SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS idx, p[i] AS text FROM (SELECT doc_id, source, p, unnest(generate_series(1, len(p))) AS i FROM pieces))
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from papyra.plans import answers, compiler, dictionaries, graphs, histories, library, pages, relational, retrieval, scalars, semantic, structures, texts  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


__all__ = ["CHUNKS", "F", "both", "docs", "oracle_sql", "queries", "query", "table"]
