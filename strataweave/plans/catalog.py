"""The engine's registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under name, with its oracle SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_mktsegment") == "BUILDING")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return (
        orders.groupBy("o_custkey")
        .agg(F.count("*").alias("n_orders"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_custkey", "n_orders")
        .orderBy(F.desc("n_orders"), "c_custkey")
        .limit(20)
    )


def _load() -> None:
    """Import the modules that register queries; they import query() from here."""
    from . import queries_analytics, queries_graph, queries_languages, queries_temporal, queries_vector  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
