"""Medallion run: raw to bronze to silver to gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from saltmarsh.operators import cleaning as cl
from saltmarsh.operators.quality import duplicate_count
from saltmarsh.operators.rows import distinct_rows, materialise
from saltmarsh.operators.sales import gold_cube, gold_from_cube
from saltmarsh.sources.sinks import write_table, write_tables
from saltmarsh.sources.tables import read_csv

LINEAGE = ("source_file", "ingestion_timestamp")

# Columns without which a row is invalid.
REQUIRED = ("transactionid", "date", "price", "totalrevenue")

# Columns typed while they are still text.
RAW_NUMBERS = {
    "price": "double",
    "totalrevenue": "double",
    "unitsold": "int",
    "unitssold": "int",
    "units_sold": "int",
    "customerage": "int",
}


def bronze_frame(raw: DataFrame) -> DataFrame:
    """Late typing of number columns plus lineage; ``raw`` is a file scan."""
    tagged = raw.select("*", F.col("_metadata.file_name").alias("_file"))
    typed = cl.sanitise_numbers(tagged, RAW_NUMBERS)
    return cl.with_lineage(typed, F.col("_file")).drop("_file")


def silver_frame(bronze: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Cleaned, typed, complete and distinct rows. Copies are judged without lineage.

    ``seen`` counts, while the frame is written, what :func:`silver_report` tells of the cleaned rows.
    """
    named = cl.fold_aliases(cl.normalise_names(bronze))
    cleaned = cl.normalise_date(cl.cast_numbers(cl.clean_text_columns(named)))
    if seen is not None:
        cleaned = cleaned.observe(seen, *_counts(cleaned.columns))
    filled = cl.fill_missing(cleaned, {"customergender": "Unknown"})
    complete = cl.require_columns(filled, computed=True)
    return distinct_rows(complete, [c for c in LINEAGE if c in complete.columns])


def _counts(columns: list[str]) -> list[Column]:
    bad = F.lit(False)
    for c in REQUIRED:
        if c in columns:
            bad = bad | F.col(c).isNull()
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns if c not in LINEAGE]
    return [F.count(F.lit(1)).alias("input_rows"), F.count_if(bad).alias("invalid_rows"), *nulls]


def raw_to_bronze(spark: SparkSession, raw: str, bronze: str, fmt: str = "parquet") -> None:
    write_table(bronze_frame(read_csv(spark, raw, typed=False)), bronze, fmt)


def bronze_to_silver(spark: SparkSession, bronze: str, silver: str) -> dict[str, int]:
    """Write silver; what was counted on the way: rows in, rows without a required value, nulls of the cleaned columns."""
    seen = Observation("silver")
    write_table(silver_frame(spark.read.parquet(bronze), seen), silver)
    return seen.get


def silver_report(bronze: DataFrame, silver: DataFrame, counted: dict[str, int]) -> DataFrame:
    """One row: what was counted while silver was written, surplus copies of bronze, rows out."""
    copies = duplicate_count(bronze, [c for c in bronze.columns if c not in LINEAGE]).select("duplicate_rows")
    out = silver.agg(F.count(F.lit(1)).alias("output_rows"))
    # Two tables of one row each, laid over each other.
    rows = copies.unionByName(out, allowMissingColumns=True).agg(F.max("duplicate_rows").alias("duplicate_rows"), F.max("output_rows").alias("output_rows"))
    return rows.select(*[F.lit(n).cast("bigint").alias(name) for name, n in counted.items()], "duplicate_rows", "output_rows")


def silver_to_gold(spark: SparkSession, silver: str, gold: str) -> dict[str, str]:
    """Write all gold tables: the base from silver, all totals from one more scan of it."""
    table = spark.read.parquet(silver)
    cube = materialise(gold_cube(table), "cube")
    return write_tables(gold_from_cube(table, cube), gold)


def full_run(spark: SparkSession, raw: str, base: str) -> dict[str, str]:
    raw_to_bronze(spark, raw, f"{base}/bronze")
    bronze_to_silver(spark, f"{base}/bronze", f"{base}/silver")
    return silver_to_gold(spark, f"{base}/silver", f"{base}/gold")
