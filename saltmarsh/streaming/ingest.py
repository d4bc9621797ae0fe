"""Incremental ingestion of raw sales files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from saltmarsh.operators.rows import row_digest
from saltmarsh.plans.medallion import LINEAGE, bronze_frame, silver_frame

# Folders of the digest store; a trigger reads those that its rows fall into.
DIGEST_BUCKETS = 64


def _digests(rows: DataFrame) -> DataFrame:
    """The rows with a digest of all but lineage, and its bucket."""
    digest = row_digest([c for c in rows.columns if c not in LINEAGE])
    found = rows.withColumn("_digest", digest)
    return found.withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(DIGEST_BUCKETS)).cast("int"))


def ingest_files(spark: SparkSession, raw: str, columns: list[str], base: str, files_per_trigger: int = 1000) -> None:
    """Clean all new CSV files below ``raw``; already seen files are skipped on the next call.

    Each trigger writes its own bronze and silver folder and overwrites it when
    it is repeated, so a lost executor or driver leaves no half-written data. Rows that
    an earlier trigger has written, whatever their lineage, are left out of silver: their
    digests are kept by bucket, and a trigger compares with those of triggers before it only.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    files = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(raw)
    typed = bronze_frame(files)
    store = f"{base}/digests"

    def land(batch: DataFrame, number: int) -> None:
        bronze, silver = (f"{base}/{layer}/trigger={number}" for layer in ("bronze", "silver"))
        batch.write.mode("overwrite").parquet(bronze)
        rows = _digests(silver_frame(spark.read.parquet(bronze)))
        if number:
            known = spark.read.schema("_digest binary, trigger int, _bucket int").parquet(store).filter(F.col("trigger") < number)
            rows = rows.join(known.select("_bucket", "_digest"), ["_bucket", "_digest"], "left_anti")
        rows.drop("_digest", "_bucket").write.mode("overwrite").parquet(silver)
        # From what was written, so that the store and silver agree.
        held = _digests(spark.read.parquet(silver)).select("_digest", "_bucket")
        held.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{store}/trigger={number}")

    query = typed.writeStream.option("checkpointLocation", f"{base}/checkpoint")
    query.foreachBatch(land).trigger(availableNow=True).start().awaitTermination()


def read_silver(spark: SparkSession, base: str) -> DataFrame:
    """Silver rows of all triggers; none is a copy of another."""
    return spark.read.parquet(f"{base}/silver").drop("trigger")
