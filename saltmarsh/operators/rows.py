"""Order and identity of rows: global numbering, first-wins de-duplication, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from saltmarsh.scratch import run_folder

# Row ids of Spark: the partition above these bits, the place in it below.
PLACE_BITS = 33


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that were just computed, without computing them a second time.

    A filter is normally pushed below the projection, which repeats the work and
    can make the generated method too long to be compiled. A row number in the
    projection keeps the filter above it. Filters on stored columns belong in
    ``filter``, where they reach the scan.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter((F.col("_row") >= 0) & condition).drop("_row")


def _fixed_width(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def row_digest(columns: Sequence[str]) -> Column:
    """Thirty-two bytes that stand for the values of a row; nulls count as values."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; ties go to the least numbers and times of the row.

    Every task keeps one row per key before the shuffle, so a key that holds a
    large part of all rows costs one row per task. Columns that nobody reads are
    not carried along.
    """
    if set(df.columns) <= set(keys):
        return df.select(*keys).distinct()
    ties = [F.col(f.name) for f in df.schema if f.name not in keys and _fixed_width(f)]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order, *ties))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def distinct_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Exact duplicates removed; ``ignore`` names lineage columns left out of the comparison.

    Of copies with different lineage the least remains.
    """
    keys = [c for c in df.columns if c not in ignore]
    if len(keys) == len(df.columns):
        return df.dropDuplicates()
    digested = df.withColumn("_digest", row_digest(keys))
    return first_per_key(digested, ["_digest"], [F.col(c) for c in ignore if c in df.columns]).drop("_digest")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id", slices: int | None = None) -> DataFrame:
    """Number all rows 0..N-1 in the given order without sorting them in one task.

    Rows are cut into ranges of the order, as many as there are shuffle partitions
    unless ``slices`` says otherwise, and sorted inside. The sorted rows are written
    once, so that places stay what they are when an executor is lost. Rows that are
    equal in the order stay in one range.
    """
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return _numbered(ranged.sortWithinPartitions(*order), name)


def number_ordered(ordered: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a sorted table 0..N-1."""
    return _numbered(ordered, name)


def _numbered(sorted_rows: DataFrame, name: str) -> DataFrame:
    place = F.monotonically_increasing_id()
    placed = materialise(sorted_rows.withColumn("_place", place), "numbered")
    part = F.shiftright("_place", PLACE_BITS).alias("_part")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the sort.
    shift = F.broadcast(counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")))
    numbered = placed.withColumn("_part", part).join(shift, "_part")
    return numbered.select(*sorted_rows.columns, (F.col("_shift") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)).alias(name))


def merge_by_key(base: DataFrame, updates: DataFrame, keys: Sequence[str], policy: str = "keep") -> DataFrame:
    """Upsert: ``keep`` leaves stored rows alone, ``replace`` lets updates win.

    Both sides must be unique per key (see :func:`first_per_key`). Each side is
    shuffled once by key.
    """
    if policy not in ("keep", "replace"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "keep":
        fresh = updates.join(base.select(*keys), list(keys), "left_anti")
        return base.unionByName(fresh, allowMissingColumns=True)
    kept = base.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def replace_groups(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Drop all stored rows of the updated keys, then add the updates."""
    changed = updates.select(key).distinct()
    return base.join(changed, key, "left_anti").unionByName(updates, allowMissingColumns=True)


def skip_existing(candidates: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(stored.select(*keys), list(keys), "left_anti")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: a fixed snapshot that outlives executors."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
