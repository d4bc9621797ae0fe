"""Search, order and page through a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saltmarsh.operators.rows import PLACE_BITS, number_ordered


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which any column holds the needle, ignoring case. Null never matches."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)), F.lit(False))
    return df.filter(hit)


def sort_rows(df: DataFrame, column: str, descending: bool = False, tiebreak: Sequence[str] = ()) -> DataFrame:
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(first, *tiebreak)


def page_rows(ordered: DataFrame, page: int, per_page: int) -> DataFrame:
    """One page of an ordered table, in order.

    Rows are numbered in the partitions of the sort, so a deep page costs no task
    more than its own share of the rows.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    first = (page - 1) * per_page
    number = F.col("_number")
    wanted = number_ordered(ordered, "_number").filter((number >= first) & (number < first + per_page))
    return wanted.orderBy("_number").drop("_number")


def page_info(df: DataFrame, page: int, per_page: int) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), pages.cast("bigint").alias("pages")
    )


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("a preview shows 1 to 100 rows")
    return df.orderBy(*order).limit(n)


def preview_info(df: DataFrame, n: int) -> DataFrame:
    """One row: all rows, rows shown, names of the columns."""
    if not 1 <= n <= 100:
        raise ValueError("a preview shows 1 to 100 rows")
    columns = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(n)).alias("shown"), columns.alias("columns"))


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def store_ordered(df: DataFrame, path: str, *order: Column | str) -> None:
    """Sort a table once and keep its order: ranges of rows in folders, with their counts beside them.

    Give an order without ties, so that a value that most rows share is cut into ranges too.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    place = F.monotonically_increasing_id()
    kept = ranged.withColumns({"_range": F.shiftright(place, PLACE_BITS).cast("int"), "_place": place.bitwiseAND((1 << PLACE_BITS) - 1)})
    kept.write.partitionBy("_range").parquet(f"{path}/rows")
    kept.limit(0).write.parquet(f"{path}/columns")
    rows = df.sparkSession.read.schema(kept.schema).parquet(f"{path}/rows")
    rows.groupBy("_range").agg(F.count(F.lit(1)).alias("count")).coalesce(1).write.parquet(f"{path}/ranges")


def open_page(spark: SparkSession, path: str, page: int, per_page: int) -> DataFrame:
    """One page of a stored order, with ``position`` from 0; only the ranges it lies in are read, and nothing else is sorted."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    first = (page - 1) * per_page
    counts = spark.read.schema("_range int, count long").parquet(f"{path}/ranges").orderBy("_range").collect()  # one row per range
    start, wanted = 0, {}
    for row in counts:
        if start < first + per_page and start + row["count"] > first:
            wanted[row["_range"]] = start
        start += row["count"]
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    position = F.col("_place")
    for number, before in wanted.items():
        position = F.when(F.col("_range") == number, F.col("_place") + before).otherwise(position)
    inside = [
        (F.col("_range") == number) & (F.col("_place") >= first - before) & (F.col("_place") < first + per_page - before)
        for number, before in wanted.items()
    ]
    chosen = rows.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
    return chosen.withColumn("position", position.cast("long")).drop("_range", "_place").orderBy("position")


def stored_info(spark: SparkSession, path: str, page: int, per_page: int) -> DataFrame:
    """As :func:`page_info`, from the counts of the ranges."""
    total = spark.read.schema("_range int, count long").parquet(f"{path}/ranges").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
    return total.select("total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), pages.alias("pages"))
