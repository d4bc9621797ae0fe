"""Vector search and re-ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from saltmarsh.functions import questions as qs, vectors as vx
from saltmarsh.functions.text import tokens

CANDIDATES = 20
FINAL = 5
# Queries, or rows of the index, that one task holds at most where both are many; few queries make one block.
QUERY_BLOCK = 2048
BLOCK = 1 << 15
# Distances held at once, and rows of the index that share one least distance where limits are looked for.
HELD = 1 << 19
SHARED = 16

# Relevance thresholds.
SHORT_QUERY_WORDS = 3
SHORT_QUERY_THRESHOLD = 0.75
THRESHOLD = 0.20
SOURCE_THRESHOLD = 0.2


def framed(names: Sequence[str], parts: Sequence[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Parts of the columns of one table put together; text stays objects."""
    columns = map(np.concatenate, zip(*parts)) if parts else [np.empty(0, object)] * len(names)
    return pd.DataFrame({n: pd.Series(c, dtype=c.dtype) for n, c in zip(names, columns)})


def _limits(rough: np.ndarray, k: int) -> np.ndarray:
    """For every line a bound that its k least values do not exceed, and few others reach."""
    groups = rough.shape[1] // SHARED
    if groups >= 4 * k:
        # The k groups with the least minima hold k values up to the k-th of these minima.
        rough = rough[:, : groups * SHARED].reshape(len(rough), SHARED, groups).min(1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def _nearest_in_block(k: int, key: str):
    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            widths = set(rows["vector"].map(len)) | set(asked["vector"].map(len))
            if len(widths) > 1:
                raise ValueError(f"vectors of different widths: {sorted(widths)}")
            points = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            wanted = np.stack(asked["vector"].to_numpy()).astype(np.float64)
            keys, names = rows["key"].to_numpy(), asked["query_id"].to_numpy()
            place = pd.factorize(keys, sort=True, use_na_sentinel=False)[0]
            # Matrix products estimate all distances, for some queries at a time. Rows within rounding of
            # the k-th estimate are then measured exactly.
            lengths, sizes = np.square(points).sum(axis=1), np.square(wanted).sum(axis=1)
            slack = 1e-9 * (lengths.max() + sizes.max() + 1.0)
            take, step, turned = min(k, len(points)), max(1, HELD // len(points)), -2.0 * points.T
            for start in range(0, len(wanted), step):
                rough = wanted[start : start + step] @ turned
                rough += lengths
                query, row = np.divmod(np.flatnonzero(rough <= (_limits(rough, take) + slack)[:, None]), len(points))
                gap = np.empty(len(row))
                for low in range(0, len(row), BLOCK):
                    some = slice(low, low + BLOCK)
                    gap[some] = np.square(points[row[some]] - wanted[start + query[some]]).sum(axis=1)
                best = np.lexsort((place[row], gap, query))
                query, row, gap = query[best], row[best], gap[best]
                near = np.arange(len(query)) - np.searchsorted(query, query) < k
                found.append((names[start + query[near]], keys[row[near]], gap[near]))
        return framed(("query_id", key, "distance"), found)

    return search


def _block_counts(rows: int, queries: int, tasks: int) -> tuple[int, int]:
    """Blocks of rows and of queries: blocks of bounded size, two pairs for every task, and little that is sent twice."""
    least_rows, least_queries = -(-rows // BLOCK), -(-queries // BLOCK)
    row_blocks = max(1, least_rows, min(tasks, round((2 * tasks * rows / queries) ** 0.5)))
    return row_blocks, max(1, least_queries, -(-2 * tasks // row_blocks))


def nearest(
    index: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    k: int = CANDIDATES,
    where: Column | None = None,
) -> DataFrame:
    """Exact k nearest rows per query: query_id, key, distance, rank.

    The index is scanned and shuffled in blocks: as many as there are shuffle
    partitions for few queries. Many queries are cut into blocks too; every block of the
    index meets every block of queries and gives its own k best of each. Queries never pass the driver. ``where`` filters
    the index first. Null vectors take no part; vectors of different widths are an error.
    """
    scanned = index if where is None else index.filter(where)
    rows = scanned.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).filter(F.col("vector").isNotNull())
    row_blocks, query_blocks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    if (wanted := queries.count()) > QUERY_BLOCK:
        row_blocks, query_blocks = _block_counts(scanned.select(key).count(), wanted, row_blocks)

    def own(name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = rows.withColumn("row_block", own("key", row_blocks)).withColumn("query_block", every(query_blocks))
    right = asked.withColumn("query_block", own("query_id", query_blocks)).withColumn("row_block", every(row_blocks))
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField(key, rows.schema["key"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    blocks = ["row_block", "query_block"]
    found = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(_nearest_in_block(k, key), schema)
    order = W.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_hits(text: Column, words: Column) -> Column:
    return F.size(F.array_intersect(words, tokens(text)))


def rerank(candidates: DataFrame, text: str = "text", words: str = "keywords", final: int = FINAL) -> DataFrame:
    """Score candidates by distance and keywords, drop the irrelevant, keep the best."""
    hits = keyword_hits(F.col(text), F.col(words))
    scored = candidates.withColumns(
        {
            "gaussian_score": vx.gaussian_score(F.col("distance")),
            "keyword_score": vx.keyword_share(hits, F.size(words)),
            "relevance_score": vx.hybrid_score(F.col("distance"), hits, F.size(words)),
        }
    )
    kept = scored.filter(relevant(F.size(words), F.col("keyword_score"), F.col("relevance_score")))
    order = W.partitionBy("query_id").orderBy(F.desc("relevance_score"), "rank")
    return kept.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= final)


def relevant(word_count: Column, keyword_score: Column, relevance: Column) -> Column:
    short = word_count <= SHORT_QUERY_WORDS
    return F.when(short, (keyword_score > 0) & (relevance >= SHORT_QUERY_THRESHOLD)).otherwise(
        relevance >= THRESHOLD
    )


def best_score_per_url(candidates: DataFrame, *keys: str) -> DataFrame:
    """Best inverse-distance score over the chunks of a url."""
    return (
        candidates.filter(F.col("url").isNotNull() & (F.col("url") != ""))
        .groupBy(*keys, "url")
        .agg(F.max(vx.inverse_score(F.col("distance"))).alias("score"))
    )


def attach_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Every article with its score, 0 when it was not found."""
    joined = articles.join(scores.select("url", "score"), "url", "left")
    return joined.withColumn("relevance_score", F.round(F.coalesce("score", F.lit(0.0)), 6)).drop("score")


def top_articles(articles: DataFrame, scores: DataFrame, k: int, *tiebreak: str) -> DataFrame:
    return attach_scores(articles, scores).orderBy(F.desc("relevance_score"), *tiebreak).limit(k)


def top_k(df: DataFrame, score: str, k: int, partition: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    if not partition:
        return df.orderBy(F.desc(score), *tiebreak).limit(k)
    order = W.partitionBy(*partition).orderBy(F.desc(score), *tiebreak)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def understand(df: DataFrame, question: str = "text") -> DataFrame:
    """Add the query profile to every question."""
    first = df.withColumn("normalized", qs.normalise(F.col(question)))
    second = first.withColumn("keywords", qs.keywords(F.col("normalized")))
    normal, words = F.col("normalized"), F.col("keywords")
    return second.withColumns(
        {
            "entities": qs.entities(normal),
            "topics": qs.topics(words),
            "intent": qs.intent(normal),
            "freshness": qs.freshness(normal),
            "expanded": qs.expanded(normal, words),
        }
    )
