"""What both vector searches share: rows that take part, copies, blocks, the best of each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Copies of a vector are cut down in this many parts first, so that none sees all copies.
COPY_PARTS = 16


def finite(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def taking_part(rows: DataFrame, key: str, vector: str, value: Callable[[Column], Column]) -> DataFrame:
    """(id, v) of the rows that can be compared; v holds ``value`` of every component as double.

    Rows without a key or with an unusable vector are left out, and so are vectors
    of another length than most. Of several rows with one key the least vector counts.
    """
    usable = rows.filter(F.col(key).isNotNull() & finite(F.col(vector)))
    lengths = usable.groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    usable = usable.filter(F.size(vector) == (usual["n"] if usual else 0))
    listed = usable.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: value(x.cast("double"))).alias("v"))
    return listed.groupBy("id").agg(F.min("v").alias("v"))


def without_surplus_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k + 1`` least ids.

    Equal vectors score alike and ties go to the lesser id, so no other copy can be
    among the k best of any query, even if one of these is the query itself.
    """
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(COPY_PARTS)))
    for keys in (["v", "_part"], ["v"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
        parted = parted.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    return parted.select(*rows.columns)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every query, ties to the lesser id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def in_blocks(
    rows: DataFrame,
    queries: DataFrame,
    cells: dict[int, tuple[int, int]],
    search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int,
    block_queries: int,
) -> DataFrame:
    """``search(rows, queries)`` for every pair of a block of rows and a block of queries of one cell.

    Both sides have ``cell`` and ``id``; ``cells`` holds (rows, queries) of every
    cell, a number of cells that does not grow with the data. A cell of any size is
    cut into blocks of bounded size, so each task holds one block of either side.
    """
    sizes = rows.sparkSession.createDataFrame(
        [(c, max(1, -(-n // block_rows)), max(1, -(-q // block_queries))) for c, (n, q) in cells.items()],
        "cell int, row_blocks int, query_blocks int",
    )
    sizes = F.broadcast(sizes)  # one row per cell

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def others(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = rows.join(sizes, "cell").withColumn("row_block", own("row_blocks")).withColumn("query_block", others("query_blocks"))
    right = queries.join(sizes, "cell").withColumn("query_block", own("query_blocks")).withColumn("row_block", others("row_blocks"))
    pair = ["cell", "row_block", "query_block"]
    left, right = (side.drop("row_blocks", "query_blocks") for side in (left, right))

    def run(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if part.empty or asked.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search(part, asked)

    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(run, schema)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)
