"""The registry of queries, and the roles that the supplied tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.shared import tasks_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """How many purchase lines there are at most, from the footers of the files."""
    return table(spark, sf_dir, "lineitem").count()


def contracts(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """Purchase lines: contract_id, line, item_id, supplier_id, customer_id, amount, day.  Where they need more tasks than the session has, both tables are dealt to as many.

    people: customer_id and what else is known of customers; it is joined to the orders, which are fewer than their lines.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    more = [] if people is None else [c for c in people.columns if c != "customer_id"]
    if people is not None:
        orders = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(people.withColumnRenamed("customer_id", "o_custkey"), "o_custkey")
    tasks = tasks_for(spark, line_count(spark, sf_dir))
    if tasks > tasks_for(spark, 0):
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderdate").cast("date").alias("day"),
        *more,
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: item_id, name, category, attributes, attribute_count."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("brand:"), F.col("p_brand"), F.lit(";size:"), F.col("p_size").cast("string")).alias("attributes"),
        F.lit(2).alias("attribute_count"),
    )


def regions(spark: SparkSession, sf_dir: str, who: str) -> DataFrame:
    """customer_id (or supplier_id) and region; nation and region have 25 and 5 rows by definition of the tables, so they are broadcast."""
    key, prefix = ("c_custkey", "c") if who == "customer" else ("s_suppkey", "s")
    places = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    people = table(spark, sf_dir, who)
    return people.join(places, F.col(f"{prefix}_nationkey") == F.col("n_nationkey")).select(F.col(key).alias(f"{who}_id"), F.col("r_name").alias("region"))


#: The same relations as SQL, for the start of a WITH.
CONTRACTS = """contracts AS (SELECT l_orderkey AS contract_id, l_linenumber AS line, l_partkey AS item_id, l_suppkey AS supplier_id, o_custkey AS customer_id,
  l_extendedprice AS amount, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CATALOG = "catalog AS (SELECT p_partkey AS item_id, p_name AS name, p_type AS category, 'brand:' || p_brand || ';size:' || CAST(p_size AS VARCHAR) AS attributes, 2 AS attribute_count FROM part)"
CUSTOMER_REGIONS = "customer_regions AS (SELECT c_custkey AS customer_id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SUPPLIER_REGIONS = "supplier_regions AS (SELECT s_suppkey AS supplier_id, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
