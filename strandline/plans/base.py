"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Two dicts (queries, SQL) and the decorator that fills them."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft list of the test tables: orders with period, day, ministry (nation of the customer) and the last ship day as deadline."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    deadline = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(deadline, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.year("o_orderdate").alias("gp"), F.col("o_orderkey").alias("inr"), F.col("c_name").alias("title"), F.col("n_name").alias("ministry"), F.col("c_nationkey").alias("ministry_code"),
        F.to_date("o_orderdate").alias("arrived"), F.to_date("last_ship").alias("deadline"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    )


#: The same in SQL, as a CTE named d.
DRAFTS_SQL = """d AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS gp, o_orderkey AS inr, c_name AS title, n_name AS ministry, c_nationkey AS ministry_code,
    CAST(o_orderdate AS DATE) AS arrived, CAST(last_ship AS DATE) AS deadline, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
)"""
