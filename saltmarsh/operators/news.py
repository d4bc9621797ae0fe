"""Stored articles: filters, roll-ups and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.functions.text import DEFAULT_TOPIC, blank_to_null

IMPACTS = ("positive", "negative", "neutral")

# Days covered by each named range.
RANGE_DAYS = {"today": 1, "yesterday": 2, "7d": 7, "30d": 30}


def topic_of(topic: Column) -> Column:
    return F.coalesce(F.nullif(topic, F.lit("")), F.lit(DEFAULT_TOPIC))


def impact_of(impact: Column) -> Column:
    """One of the known impacts; anything else counts as neutral."""
    lowered = F.lower(F.coalesce(impact, F.lit("neutral")))
    return F.when(lowered.isin(*IMPACTS), lowered).otherwise("neutral")


def topic_summary(articles: DataFrame) -> DataFrame:
    """Article and impact counts per topic, newest first. Combined on the map side."""
    impact = impact_of(F.col("impact")) if "impact" in articles.columns else F.lit("neutral")
    rows = articles.select(topic_of(F.col("topic")).alias("topic"), impact.alias("impact"), "collected_at")
    return (
        rows.groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("article_count"),
            *[F.count_if(F.col("impact") == name).alias(name) for name in IMPACTS],
            F.max("collected_at").alias("last_updated"),
        )
        .orderBy(F.desc("last_updated"), "topic")
    )


def article_total(topics: DataFrame) -> DataFrame:
    return topics.agg(F.coalesce(F.sum("article_count"), F.lit(0)).alias("stored_articles"))


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def filter_articles(
    articles: DataFrame,
    topic: str | None = None,
    search: str | None = None,
    source: str | None = None,
    impact: str | None = None,
) -> DataFrame:
    out = articles
    if topic:
        out = out.filter(same_text(topic_of(F.col("topic")), topic))
    if search:
        needle = F.lit(search.lower())
        out = out.filter(
            F.contains(F.lower(F.coalesce("title", F.lit(""))), needle)
            | F.contains(F.lower(F.coalesce("content", F.lit(""))), needle)
        )
    if source:
        out = out.filter(same_text(F.coalesce("source", F.lit("")), source))
    if impact:
        stored = F.coalesce("impact", F.lit("neutral")) if "impact" in out.columns else F.lit("neutral")
        out = out.filter(same_text(stored, impact))
    return out


def collected_within(articles: DataFrame, name: str, as_of: Column, column: str = "collected_at") -> DataFrame:
    """Rows collected in the named range before ``as_of``; rows without a time are dropped."""
    if name == "all":
        return articles
    return articles.filter(F.col(column) >= as_of - F.make_dt_interval(days=F.lit(RANGE_DAYS[name])))


def collection_summary(articles: DataFrame, session: str = "research_session_id") -> DataFrame:
    """Items read and items with text, per session."""
    return articles.groupBy(session).agg(
        F.count(F.lit(1)).alias("articles_extracted"),
        F.count_if(blank_to_null(F.col("content")).isNotNull()).alias("articles_with_content"),
    )


def store_outcomes(candidates: DataFrame, stored: DataFrame, session: str = "research_session_id") -> DataFrame:
    """Stored, skipped, failed and verified counts of a keep-existing upsert, per session."""
    known = stored.select("object_key").distinct().withColumn("_known", F.lit(True))
    marked = candidates.join(known, "object_key", "left")
    usable = blank_to_null(F.col("content")).isNotNull()
    outcome = F.when(F.col("_known"), "skipped").when(usable, "stored").otherwise("failed")
    counted = marked.withColumn("outcome", outcome).groupBy(session)
    return counted.agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in ("stored", "skipped", "failed")],
        F.count_if(F.col("outcome") != "failed").alias("verified"),
    )


def session_summary(articles: DataFrame) -> DataFrame:
    """One record per topic and session, as kept beside the articles."""
    return articles.groupBy("topic", "research_session_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.max("collected_at").alias("created_at")
    )
