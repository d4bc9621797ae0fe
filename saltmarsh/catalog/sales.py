"""Gold aggregates over the sales lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.operators import sales as op
from saltmarsh.plans.medallion import silver_to_gold
from saltmarsh.scratch import run_folder
from saltmarsh.sources.sinks import verified_write

BOOK = Book()

_SQL_REVENUE = "l_extendedprice * (1 - l_discount)"


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def sums_per(lines: DataFrame, key: str) -> DataFrame:
    """Sales lines summed per join key before the join.

    One row per key and task enters the shuffle, so a key with a large part of
    all lines is neither shuffled whole nor joined in one task.
    """
    return lines.groupBy(key).agg(
        F.sum(revenue()).alias("totalrevenue"), F.sum("l_quantity").alias("unitssold")
    )


def dated_sums(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    joined = sums_per(t.lineitem, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("date", "totalrevenue", "unitssold")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


@BOOK.add(
    "a01_sales_by_product",
    f"""SELECT p_brand AS mobilemodel, round(sum({_SQL_REVENUE}), 4) AS total_sales,
               CAST(sum(l_quantity) AS BIGINT) AS total_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def _product(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", F.col("p_brand").alias("mobilemodel"))
    joined = sums_per(t.lineitem, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(op.sales_by_product(joined), "total_sales")


@BOOK.add(
    "a02_sales_by_location",
    f"""SELECT n_name AS location, round(sum({_SQL_REVENUE}), 4) AS total_sales,
               CAST(sum(l_quantity) AS BIGINT) AS total_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _location(t: Tables) -> DataFrame:
    per_order = sums_per(t.lineitem, "l_orderkey")
    orders = t.orders.select("o_orderkey", "o_custkey")
    per_customer = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("totalrevenue").alias("totalrevenue"), F.sum("unitssold").alias("unitssold"))
    )
    customer = t.customer.select("c_custkey", "c_nationkey")
    per_nation = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    named = per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(op.sales_by_location(named.withColumnRenamed("n_name", "location")), "total_sales")


@BOOK.add(
    "a03_daily_sales",
    f"""SELECT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
               strftime(o_orderdate, '%Y-%m') AS month, round(sum({_SQL_REVENUE}), 4) AS total_sales,
               CAST(sum(l_quantity) AS BIGINT) AS total_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)
def _daily(t: Tables) -> DataFrame:
    return rounded(op.daily_sales(dated_sums(t)), "total_sales")


@BOOK.add(
    "a04_monthly_sales",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS month,
               round(sum({_SQL_REVENUE}), 4) AS total_sales, CAST(sum(l_quantity) AS BIGINT) AS total_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def _monthly(t: Tables) -> DataFrame:
    return rounded(op.monthly_sales(dated_sums(t)), "total_sales")


@BOOK.add(
    "a05_sales_summary",
    f"""SELECT round(sum({_SQL_REVENUE}), 4) AS total_sales, round(avg({_SQL_REVENUE}), 4) AS average_sales,
               CAST(sum(l_quantity) AS BIGINT) AS total_quantity FROM lineitem""",
)
def _summary(t: Tables) -> DataFrame:
    lines = t.lineitem.select(revenue().alias("totalrevenue"), F.col("l_quantity").alias("unitssold"))
    return rounded(op.sales_summary(lines), "total_sales", "average_sales")


@BOOK.add(
    "a06_optional_measures",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS month,
              round(sum(o_totalprice), 4) AS total_sales FROM orders GROUP BY 1, 2""",
)
def _optional(t: Tables) -> DataFrame:
    orders = t.orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("totalrevenue"))
    return rounded(op.monthly_sales(orders), "total_sales")


@BOOK.add(
    "p09_calendar_columns",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
              strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
)
def _calendar(t: Tables) -> DataFrame:
    return op.with_calendar(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date")))


@BOOK.add(
    "p10_time_analysis",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
              strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS totalrevenue FROM orders""",
)
def _time_analysis(t: Tables) -> DataFrame:
    orders = t.orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("totalrevenue"))
    return op.time_analysis(orders)


_GOLD_SQL = f"""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d, n_name, p_brand, {_SQL_REVENUE} AS r, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
SELECT 'base' AS output, CAST(NULL AS VARCHAR) AS key, round(sum(r), 4) AS total_sales,
       CAST(sum(q) AS BIGINT) AS total_quantity, count(*) AS row_count FROM s
UNION ALL SELECT 'sales_by_product', p_brand, round(sum(r), 4), CAST(sum(q) AS BIGINT), 1 FROM s GROUP BY 2
UNION ALL SELECT 'sales_by_location', n_name, round(sum(r), 4), CAST(sum(q) AS BIGINT), 1 FROM s GROUP BY 2
UNION ALL SELECT 'daily_sales', strftime(d, '%Y-%m-%d'), round(sum(r), 4), CAST(sum(q) AS BIGINT), 1 FROM s GROUP BY 2
UNION ALL SELECT 'monthly_sales', strftime(d, '%Y-%m'), round(sum(r), 4), CAST(sum(q) AS BIGINT), 1 FROM s GROUP BY 2
UNION ALL SELECT 'summary', NULL, round(sum(r), 4), CAST(sum(q) AS BIGINT), 1 FROM s
"""


def sales_lines(t: Tables) -> DataFrame:
    """The sales table at line grain, in silver layout."""
    orders = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    customers = t.customer.select("c_custkey", "c_nationkey")
    nations = t.nation.select("n_nationkey", F.col("n_name").alias("location"))
    parts = t.part.select("p_partkey", F.col("p_brand").alias("mobilemodel"))
    return (
        t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transactionid"),
            "date",
            "mobilemodel",
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("int").alias("unitssold"),
            revenue().alias("totalrevenue"),
            "location",
        )
    )


@BOOK.add("k02_gold_outputs", _GOLD_SQL)
def _gold(t: Tables) -> DataFrame:
    """Write silver once, derive and write all gold tables from it, read them back."""
    base = run_folder(t.spark, "gold")
    verified_write(sales_lines(t), f"{base}/silver")
    paths = silver_to_gold(t.spark, f"{base}/silver", f"{base}/gold")
    keys = {
        "sales_by_product": "mobilemodel",
        "sales_by_location": "location",
        "daily_sales": "date",
        "monthly_sales": "month",
        "summary": None,
    }
    parts = [
        t.spark.read.parquet(paths["base"]).agg(
            F.lit("base").alias("output"),
            F.lit(None).cast("string").alias("key"),
            F.round(F.sum("totalrevenue"), 4).alias("total_sales"),
            F.sum("unitssold").cast("bigint").alias("total_quantity"),
            F.count(F.lit(1)).alias("row_count"),
        )
    ]
    for name, key in keys.items():
        label = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
        parts.append(
            t.spark.read.parquet(paths[name]).select(
                F.lit(name).alias("output"),
                label.alias("key"),
                F.round("total_sales", 4).alias("total_sales"),
                "total_quantity",
                F.lit(1).cast("bigint").alias("row_count"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
