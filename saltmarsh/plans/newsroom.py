"""Pages to stored articles to topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.functions import text as tx, urls
from saltmarsh.operators.html import extract_articles, is_login_page
from saltmarsh.operators.news import topic_summary
from saltmarsh.sources.documents import EXTERNAL
from saltmarsh.sources.sinks import store_articles


def collected_articles(pages: DataFrame, query: Column, session: Column, collected_at: Column, source: Column | None = None) -> DataFrame:
    """Store records of readable pages (page_id, url, html)."""
    readable = pages.filter(~is_login_page(F.col("url"), F.col("html")))
    found = extract_articles(readable.withColumns({"query": query, "research_session_id": session, "collected_at": collected_at}))
    origin = urls.host(F.col("url")) if source is None else source
    rows = found.withColumn("source", origin)
    return rows.select(
        urls.object_key(F.col("source"), F.col("url")).alias("object_key"),
        urls.artifact_id(F.col("url")).alias("artifact_id"),
        tx.topic_name(F.col("query")).alias("topic"),
        F.lit(EXTERNAL).alias("source_type"),
        F.lit("minio").alias("storage"),
        *[c for c in rows.columns if c != "page_id"],
    )


def refresh_store(stored: DataFrame, incoming: DataFrame, policy: str = "keep") -> tuple[DataFrame, DataFrame]:
    """Merged store and its topic roll-up."""
    merged = store_articles(stored, incoming, policy)
    return merged, topic_summary(merged)
