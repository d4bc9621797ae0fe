"""Sinks: tables, verified writes, manifests, article store, index snapshots."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from saltmarsh.functions.text import slug
from saltmarsh.operators.quality import quality_score
from saltmarsh.operators.rows import first_per_key, merge_by_key, replace_groups


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: object) -> None:
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write several outputs below one folder."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{base}/{name}"
        write_table(df, paths[name], fmt)
    return paths


def checksum(df: DataFrame) -> DataFrame:
    """Row count and order-free checksum in one pass; the decimal sum cannot overflow."""
    digest = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("checksum")
    )


def verified_write(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet and compare what was read back with what was sent.

    The metrics of the sent rows are gathered during the write itself.
    """
    from pyspark.sql import Observation

    sent = Observation()
    digest = F.xxhash64(*df.columns).cast("decimal(38,0)")
    df.observe(
        sent,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("checksum"),
    ).write.mode("overwrite").parquet(path)
    expected = sent.get
    found = checksum(df.sparkSession.read.schema(df.schema).parquet(path))
    ok = (F.col("row_count") == expected["rows"]) & (F.col("checksum") == F.lit(expected["checksum"]).cast("decimal(38,0)"))
    return found.select(
        F.lit(expected["rows"]).cast("bigint").alias("rows_sent"), F.col("row_count").alias("rows_stored"), ok.alias("verified")
    )


def layer_metadata(df: DataFrame, layer: str, job_id: str, source: str, path: str, copies: bool = True) -> DataFrame:
    """One row describing a layer: size, columns, schema, quality, lineage.

    Without ``copies`` the quality is that of the rows as they are, from one pass and no shuffle of rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return quality_score(df, copies).select(
        F.lit(layer).alias("layer"),
        F.lit(job_id).alias("job_id"),
        (F.col("row_count") + F.col("duplicates_removed")).alias("row_count"),
        "column_count",
        F.lit(json.dumps(list(fields))).alias("columns"),
        F.lit(json.dumps(fields)).alias("schema"),
        "quality_score",
        "missing_values",
        "missing_percentage",
        "duplicates_removed",
        F.lit(source).alias("source_object"),
        F.lit(path).alias("object"),
        F.lit("completed").alias("status"),
        F.current_timestamp().alias("processing_timestamp"),
    )


def write_manifest(spark: SparkSession, path: str, job_id: str, source_file: str, created_at: str, stages: Mapping[str, Mapping]) -> None:
    manifest = {"job_id": job_id, "source_file": source_file, "created_at": created_at, "stages": stages}
    spark.range(1).select(F.lit(json.dumps(manifest, default=str)).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per stage of every manifest below the path."""
    stage = "struct<rows: bigint, status: string, object: string>"
    schema = f"job_id string, source_file string, created_at string, stages map<string, {stage}>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("m")).select("m.*")
    listed = parsed.select("job_id", "source_file", "created_at", F.explode("stages").alias("stage", "facts"))
    return listed.select("job_id", "source_file", "created_at", "stage", "facts.*")


FILES_PER_SOURCE = 16


def latest_articles(incoming: DataFrame) -> DataFrame:
    """One article per key, the first collected."""
    return first_per_key(incoming, ["object_key"], [F.col("collected_at")])


def store_articles(stored: DataFrame, incoming: DataFrame, policy: str = "keep") -> DataFrame:
    """Merged article store, one record per object key."""
    return merge_by_key(stored, latest_articles(incoming), ["object_key"], policy)


def write_article_store(articles: DataFrame, path: str) -> None:
    """One folder per source, written as JSON lines to a new snapshot path."""
    sliced = articles.withColumn("source_slug", slug(F.coalesce("source", F.lit("unknown_source"))))
    # A few files per source; a source with most articles is still written by many tasks.
    sliced = sliced.repartition("source_slug", F.pmod(F.xxhash64("object_key"), F.lit(FILES_PER_SOURCE)))
    sliced.write.partitionBy("source_slug").json(path)


def refresh_index(index: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """New index snapshot in which the chunks replace all rows of their object keys."""
    merged = replace_groups(index, chunks, "object_key")
    merged.write.parquet(path)
    return index.sparkSession.read.schema(merged.schema).parquet(path)
