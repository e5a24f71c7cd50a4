"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def values(spark: SparkSession, fixture: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {fixture}")


def relational(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query whose SQL both engines read: Spark plans it over views of the tables it names."""
    text = spark_sql or sql

    def run(spark: SparkSession, sf: str) -> DataFrame:
        used = {t: table(spark, sf, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        for t, df in used.items():
            df.createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLES[name] = run, sql
