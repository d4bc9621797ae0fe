"""Question to evidence: understand, embed, search, re-rank, render."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from saltmarsh.operators.evidence import context_text
from saltmarsh.operators.ranking import CANDIDATES, FINAL, nearest, rerank, understand
from saltmarsh.operators.vectorize import hash_vectors

Embedder = Callable[[DataFrame, str], DataFrame]


def hashing(dimensions: int) -> Embedder:
    return lambda df, text: hash_vectors(df, text, dimensions)


def retrieve(
    index: DataFrame,
    questions: DataFrame,
    embed: Embedder,
    source_type: str | None = None,
    candidates: int = CANDIDATES,
    final: int = FINAL,
) -> DataFrame:
    """Best chunks per question.

    ``index`` has chunk_key, text, embedding and display columns;
    ``questions`` has query_id and text. The candidates, at most a handful per
    question, are joined back to the index for their text.
    """
    asked = embed(understand(questions).select("query_id", "keywords", "expanded"), "expanded")
    where = None if source_type is None else F.col("source_type") == source_type
    # where-filter and top-k happen in one scan of key and vector only
    found = nearest(index, asked, key="chunk_key", k=candidates, where=where)
    words = asked.select("query_id", "keywords")
    texts = index.drop("embedding").join(found, "chunk_key")
    return rerank(texts.join(words, "query_id"), final=final)


def evidence_context(results: DataFrame) -> DataFrame:
    return context_text(results, rank="final_rank")
