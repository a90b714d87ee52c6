"""Fixture binding: driver tables -> the ``transactions`` table.

The binding is a fixture, not an operator (FIXTURES.md section 3). The Spark
plan below and ``BINDING_SQL`` (run by DuckDB in the oracle) compute the same
rows: one row per lineitem.

Scale notes: customers are enriched with their region first (nation and
region are fixed-size tables; Catalyst broadcasts them by file size), then
orders meet their customer - an orders-sized shuffle on the customer key.
Lineitem, the largest input, is then shuffled once per remaining key (order,
part, and supplier where it is too large for a broadcast, by a count); the
signed price is made before, so that a row is four numbers in the first
shuffle. Every input is pruned to the columns used before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.sizes import small

#: Suppliers (key and name) that are broadcast, some 100 bytes each in memory.
BROADCAST_SUPPLIERS = 500_000

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def bind_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the 8-column transaction table from the driver tables."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    signed = F.when(F.col("l_returnflag") == "R", price).otherwise(-price)
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", signed.cast("double").alias("amount"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    cust = customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        "c_custkey", F.col("c_mktsegment").alias("profile"), F.col("r_name").alias("bank")
    )

    # Orders meet their customer first (an orders-sized shuffle), so the
    # lineitem-sized side is shuffled once per remaining key: order, part.
    # The name columns join last so they ride through few shuffles.
    order_cust = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "date", "profile", "bank")
    return (
        li.join(order_cust, li.l_orderkey == order_cust.o_orderkey)
        .join(part, F.col("l_partkey") == part.p_partkey)
        .join(small(supplier, BROADCAST_SUPPLIERS), F.col("l_suppkey") == supplier.s_suppkey)
        .select(
            "date",
            F.col("s_name").alias("merchant"),
            F.col("p_name").alias("description"),
            "amount",
            F.col("p_type").alias("category"),
            "profile",
            "bank",
            F.lit("CAD").alias("currency"),
        )
    )


# Same rows as ``bind_transactions``, for DuckDB (tables pre-registered as views).
BINDING_SQL = """
SELECT CAST(o.o_orderdate AS DATE) AS date,
       s.s_name AS merchant,
       p.p_name AS description,
       CAST(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS DECIMAL(18,2))
                 ELSE -CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount,
       p.p_type AS category,
       c.c_mktsegment AS profile,
       r.r_name AS bank,
       'CAD' AS currency
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""


def with_transactions(sql: str, stored: bool = False) -> str:
    """Prefix a query over ``transactions`` with the binding CTE; ``stored`` makes DuckDB compute it once (it fails
    internally on some joins with the parquet tables' dictionaries)."""
    body, kind = sql.strip(), "MATERIALIZED " if stored else ""
    if body.upper().startswith("WITH "):
        return f"WITH transactions AS {kind}({BINDING_SQL}),\n{body[5:]}"
    return f"WITH transactions AS {kind}({BINDING_SQL})\n{body}"
