"""Registration of queries over the test tables and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent for DuckDB, where SQL can say it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values placed by rule (the tables have none)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax",
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
    )


GAPS_SQL = """
gaps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice,
         l_discount, l_tax,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)
"""


def stack_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def hash_sql(expression: str) -> str:
    """DuckDB form of ``functions.hashing.text_hash``."""
    return f"(('0x' || substr(md5({expression}), 1, 15))::BIGINT)"


def order_hash_sql(key: str, seed: int = 42) -> str:
    return hash_sql(f"CAST({key} AS VARCHAR) || '|{seed}'")
