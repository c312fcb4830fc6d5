"""The register of queries: a function of (spark, sf_dir) and, where SQL has it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atelier.plans.views import duck_sql, spark_sql, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duck_sql(oracle)
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that is one SQL text; it runs on Spark, and DuckDB checks it."""
    QUERIES[name] = lambda spark, sf_dir: spark_sql(spark, sf_dir, text)
    ORACLES[name] = duck_sql(oracle or text)


__all__ = ["ORACLES", "QUERIES", "query", "spark_sql", "sql", "view"]
