"""Queries and their SQL, registered by the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query. ``doubles``: its columns that both engines round, as sums of doubles depend on the order of rows."""
    names = doubles.split()

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, digits) for c in names}) if names else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names)}) FROM ({sql.strip()})" if names else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and month: a panel of five series; prices in millions."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date")
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("grp"), month.alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("price"), F.count("*").cast("double").alias("n"))


PANEL = """panel AS (
  SELECT o_orderpriority AS grp, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS price, count(*)::DOUBLE AS n
  FROM orders GROUP BY ALL
)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("value"))


DAYS = "days AS (SELECT user_id, ts::DATE AS day, count(*)::DOUBLE AS n, sum(value) AS value FROM events GROUP BY ALL)"
