"""Profiles and quality reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.cleaning import _GAPS, orders_with_gaps
from saltmarsh.operators import profiles, quality as op
from saltmarsh.scratch import run_folder

BOOK = Book()


@BOOK.add(
    "a07_null_counts",
    f"""SELECT column_name, null_count FROM (UNPIVOT (SELECT
          count(*) FILTER (transactionid IS NULL) AS transactionid, count(*) FILTER (date IS NULL) AS date,
          count(*) FILTER (price IS NULL) AS price, count(*) FILTER (totalrevenue IS NULL) AS totalrevenue FROM {_GAPS})
        ON transactionid, date, price, totalrevenue INTO NAME column_name VALUE null_count)""",
)
def _nulls(t: Tables) -> DataFrame:
    return op.null_counts(orders_with_gaps(t))


@BOOK.add(
    "a08_duplicate_count",
    """SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_rows,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents""",
)
def _copies(t: Tables) -> DataFrame:
    return op.duplicate_count(t.documents, ["text", "lang"])


@BOOK.add(
    "a09_table_profile",
    """WITH p AS (SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events)
       SELECT '*' AS column_name, 'rows' AS metric, CAST(n AS VARCHAR) AS value FROM p
       UNION ALL SELECT '*', 'columns', '4' UNION ALL SELECT '*', 'duplicate_rows',
         CAST((SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT ts, user_id, event_type, value FROM events)) AS VARCHAR)
       UNION ALL SELECT c, 'dtype', d FROM (VALUES ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double')) v(c, d)
       UNION ALL SELECT c, 'null_count', '0' FROM (VALUES ('ts'), ('user_id'), ('event_type'), ('value')) v(c)
       UNION ALL SELECT c, 'role', r FROM (VALUES ('user_id', 'numeric'), ('value', 'numeric'), ('ts', 'datetime')) v(c, r)
       UNION ALL SELECT 'ts', 'min_date', strftime(lo, '%Y-%m-%d') FROM p
       UNION ALL SELECT 'ts', 'max_date', strftime(hi, '%Y-%m-%d') FROM p""",
)
def _profile(t: Tables) -> DataFrame:
    return op.table_profile(t.events.select("ts", "user_id", "event_type", "value"))


@BOOK.add(
    "a10_quality_score",
    """WITH d AS (SELECT DISTINCT text, CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE lang END AS lang FROM documents),
            m AS (SELECT count(*) AS n, count(*) FILTER (lang IS NULL) AS miss FROM d)
       SELECT n AS row_count, 2 AS column_count, miss AS missing_values, round(miss * 100.0 / greatest(1, n * 2), 2) AS missing_percentage,
              (SELECT count(*) FROM documents) - n AS duplicates_removed,
              round(greatest(0.0, 100.0 * (1 - CAST(miss AS DOUBLE) / greatest(1, n * 2))), 2) AS quality_score FROM m""",
)
def _score(t: Tables) -> DataFrame:
    lang = F.when(~F.col("source").isin("src1", "src2"), F.col("lang"))
    return op.quality_score(t.documents.select("text", lang.alias("lang")))


@BOOK.add(
    "f12_distinct_share",
    """SELECT 'c_custkey' AS column_name, count(*) AS row_count, count(DISTINCT c_custkey) AS distinct_count,
              round(count(DISTINCT c_custkey) / CAST(count(*) AS DOUBLE), 6) AS distinct_share FROM customer
       UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey),
              round(count(DISTINCT c_nationkey) / CAST(count(*) AS DOUBLE), 6) FROM customer""",
)
def _share(t: Tables) -> DataFrame:
    return op.distinct_share(t.customer, "c_custkey").unionByName(op.distinct_share(t.customer, "c_nationkey"))


@BOOK.add(
    "a18_column_statistics",
    """SELECT c AS column_name, n AS row_count, round(m, 4) AS mean, round(s, 4) AS stddev, CAST(number_share AS DOUBLE) AS number_share, CAST(date_share AS DOUBLE) AS date_share FROM (
         SELECT 'l_quantity' AS c, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, 1.0 AS number_share, 0.0 AS date_share FROM lineitem
         UNION ALL SELECT 'l_extendedprice', count(*), avg(l_extendedprice), stddev_samp(l_extendedprice), 1.0, 0.0 FROM lineitem
         UNION ALL SELECT 'l_shipdate', count(*), NULL, NULL, 0.0, 1.0 FROM lineitem
         UNION ALL SELECT 'l_returnflag', count(*), NULL, NULL, 0.0, 0.0 FROM lineitem)""",
)
def _statistics(t: Tables) -> DataFrame:
    stats = op.column_statistics(t.lineitem.select("l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"))
    return stats.select(
        "column_name", "row_count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "number_share", "date_share"
    )


@BOOK.add(
    "a18_merged_profile",
    """SELECT c AS column_name, n AS rows, nulls, round(m, 4) AS mean, round(s, 4) AS stddev, lo AS least, hi AS most, TRUE AS distinct_in_range, TRUE AS median_in_range FROM (
         SELECT 'l_quantity' AS c, count(*) AS n, 0 AS nulls, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem
         UNION ALL SELECT 'price', count(*), count(*) FILTER (l_linenumber = 3), avg(l_extendedprice) FILTER (l_linenumber <> 3), stddev_samp(l_extendedprice) FILTER (l_linenumber <> 3),
           min(l_extendedprice) FILTER (l_linenumber <> 3), max(l_extendedprice) FILTER (l_linenumber <> 3) FROM lineitem
         UNION ALL SELECT 'l_partkey', count(*), 0, avg(l_partkey), stddev_samp(l_partkey), min(l_partkey), max(l_partkey) FROM lineitem)""",
)
def _merged_profile(t: Tables) -> DataFrame:
    """Profiles of three loads, stored and merged, against exact counts of the whole table."""
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price")
    lines = t.lineitem.select("l_quantity", price, "l_partkey", (F.col("l_orderkey") % 3).alias("load"))
    path = run_folder(t.spark, "profiles")
    for load in range(3):
        profiles.store_profile(profiles.load_profile(lines.filter(F.col("load") == load).drop("load")), path, str(load))
    found = profiles.described(profiles.merged(profiles.stored_profiles(t.spark, path))).filter(F.col("column_name") != profiles.WHOLE)
    exact = op.distinct_share(lines, "l_quantity").unionByName(op.distinct_share(lines, "price")).unionByName(op.distinct_share(lines, "l_partkey"))
    columns = ("l_quantity", "price", "l_partkey")
    medians = {r["column_name"]: r["quantile"] for r in found.collect()}  # one row per column
    below = lines.agg(*[F.avg((F.col(c) < medians[c]).cast("int")).alias(f"{c}_low") for c in columns], *[F.avg((F.col(c) <= medians[c]).cast("int")).alias(f"{c}_high") for c in columns]).first()
    inside = F.create_map(*[F.lit(x) for c in columns for x in (c, below[f"{c}_low"] - profiles.RANK_ERROR <= 0.5 <= below[f"{c}_high"] + profiles.RANK_ERROR)])
    off = F.abs(F.col("distinct_count") - F.col("exact")) / F.col("exact")
    return found.join(exact.select("column_name", F.col("distinct_count").alias("exact")), "column_name").select(
        "column_name", "rows", "nulls", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "least", "most",
        (off <= profiles.DISTINCT_ERROR).alias("distinct_in_range"), inside[F.col("column_name")].alias("median_in_range"),
    )


@BOOK.add(
    "e09_column_roles",
    """SELECT * FROM (VALUES ('l_shipdate', 'date', 0), ('l_orderkey', 'numeric', 0), ('l_quantity', 'numeric', 0),
         ('l_extendedprice', 'numeric', 0), ('l_discount', 'numeric', 0), ('l_extendedprice', 'target', 18)) v(column_name, role, score)
       WHERE (SELECT stddev_samp(l_extendedprice) / avg(l_extendedprice) FROM lineitem) > 0.1""",
)
def _roles(t: Tables) -> DataFrame:
    """Dates by type (no column name says date here besides l_shipdate), target by score."""
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    roles = op.column_roles(lines)
    return t.spark.createDataFrame(
        [(r["column_name"], r["role"], r["score"]) for r in roles], "column_name string, role string, score int"
    )


@BOOK.add(
    "e09_series_columns",
    """SELECT 'order_date' AS date_column, CASE WHEN count(total_value) >= count(other_amount) THEN 'total_value' ELSE 'other_amount' END AS metric_column
       FROM (SELECT o_totalprice AS total_value, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS other_amount FROM orders)""",
)
def _series_columns(t: Tables) -> DataFrame:
    """Date and metric of the daily forecast: of two amounts the one that is filled more often."""
    filled = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    orders = t.orders.select(
        F.col("o_orderkey").alias("number"), F.col("o_orderdate").cast("date").alias("order_date"), filled.alias("other_amount"),
        F.col("o_totalprice").alias("total_value"), F.col("o_custkey").alias("units"),
    )
    return t.spark.createDataFrame([op.choose_series_columns(orders)], "date_column string, metric_column string")
