"""Index snapshot: scan, chunk, embed, replace changed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.operators.chunking import chunk_documents
from saltmarsh.plans.retrieval import Embedder


def internal_chunk_id(bucket: str, etag: Column) -> Column:
    return F.concat_ws(":", F.lit("minio"), F.lit(bucket), "object_key", etag, F.col("page").cast("string"), F.col("chunk").cast("string"))


def news_chunk_id() -> Column:
    return F.concat_ws(":", F.lit("news"), "object_key", F.col("chunk").cast("string"))


def internal_rows(objects: DataFrame, bucket: str) -> DataFrame:
    """Chunks of text objects; the entity tag is a digest of the object's text."""
    tagged = objects.withColumn("etag", F.md5("text"))
    rows = chunk_documents(tagged)
    return rows.select(
        internal_chunk_id(bucket, F.col("etag")).alias("id"), F.lit("internal_document").alias("source_type"), F.lit(bucket).alias("bucket"), *rows.columns
    )


def news_rows(articles: DataFrame, bucket: str = "news") -> DataFrame:
    rows = chunk_documents(articles.withColumnRenamed("content", "text").withColumn("page", F.lit(0)))
    return rows.select(news_chunk_id().alias("id"), F.lit("external_news").alias("source_type"), F.lit(bucket).alias("bucket"), *rows.columns)


def index_rows(internal: DataFrame, news: DataFrame, embed: Embedder) -> DataFrame:
    """All chunks with vectors and a numeric key."""
    both = internal.unionByName(news, allowMissingColumns=True)
    return embed(both.withColumn("chunk_key", F.xxhash64("id")), "text")
