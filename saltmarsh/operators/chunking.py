"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.functions import text as tx
from saltmarsh.functions.urls import article_id


def chunk_documents(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """Replace the text by its chunks, numbered from 0 within the document."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(tx.chunks(F.col(text), size, overlap)).alias("chunk", "text"))


def page_chunks(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Chunks of page-marked text: source, page, chunk, text."""
    pages = df.select(F.col(source).alias("source"), F.explode(tx.marked_pages(F.col(text))).alias("p"))
    return chunk_documents(pages.select("source", "p.page", "p.text"))


def article_chunks(df: DataFrame, size: int = 4500, overlap: int = 500) -> DataFrame:
    """Index rows of articles (url, title, content): id, window number and titled text."""
    cut = df.select(
        *[c for c in df.columns if c != "content"],
        F.explode(tx.article_windows(tx.strip(F.col("content")), size, overlap)).alias("w"),
    )
    return cut.select(
        *[c for c in cut.columns if c != "w"],
        article_id(F.col("url")).alias("article_id"),
        F.col("w.chunk").alias("chunk"),
        F.concat_ws("-", article_id(F.col("url")), F.col("w.chunk").cast("string")).alias("chunk_id"),
        F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n\n"), F.col("w.text")).alias("text"),
    )
