"""Article store, topics and filters, with documents as articles and labels as impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.documents import SQL_ARTICLES
from saltmarsh.operators import news as op
from saltmarsh.operators.paging import lookup
from saltmarsh.operators.rows import merge_by_key, skip_existing
from saltmarsh.plans.newsroom import collected_articles, refresh_store
from saltmarsh.scratch import run_folder
from saltmarsh.sources import snapshots
from saltmarsh.sources.sinks import latest_articles, refresh_index, store_articles, write_article_store

BOOK = Book()

# Collection time: two documents an hour, from the start of 2024.
START = "2024-01-01 00:00:00"


def articles(t: Tables) -> DataFrame:
    """Documents as stored articles; labels give the impact."""
    marks = t.labels.select(
        F.col("doc_id"),
        F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "POSITIVE").otherwise("unclear").alias("impact"),
    )
    docs = t.documents.select(
        "doc_id",
        F.col("source"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("lang") != "en", F.concat(F.lit("Topic "), F.col("lang"))).otherwise("").alias("topic"),
        F.timestamp_add("MINUTE", (F.col("doc_id") * 30).cast("int"), F.lit(START).cast("timestamp_ntz")).alias("collected_at"),
        F.concat_ws("/", "source", F.concat(F.lit("d-"), F.col("doc_id").cast("string"), F.lit(".json"))).alias("object_key"),
        F.concat(F.lit("session-"), F.col("lang")).alias("research_session_id"),
    )
    return docs.join(marks, "doc_id", "left")


A = """a AS (SELECT d.doc_id, source, left(text, 60) AS title, text AS content, CASE WHEN lang <> 'en' THEN 'Topic ' || lang ELSE '' END AS topic,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(30 * d.doc_id) AS collected_at, source || '/d-' || d.doc_id || '.json' AS object_key, 'session-' || lang AS research_session_id,
  CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'POSITIVE' WHEN quality = 0 THEN 'unclear' END AS impact FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_TOPICS = f"""WITH {A}, m AS (SELECT coalesce(nullif(topic, ''), 'General News') AS topic, CASE WHEN lower(impact) IN ('positive', 'negative') THEN lower(impact) ELSE 'neutral' END AS i, collected_at FROM a)
SELECT topic, count(*) AS article_count, count(*) FILTER (i = 'positive') AS positive, count(*) FILTER (i = 'negative') AS negative,
       count(*) FILTER (i = 'neutral') AS neutral, max(collected_at) AS last_updated FROM m GROUP BY 1"""


@BOOK.add("a15_topic_summary", _TOPICS)
def _topics(t: Tables) -> DataFrame:
    return op.topic_summary(articles(t))


@BOOK.add("a17_article_total", "SELECT count(*) AS stored_articles FROM documents")
def _total(t: Tables) -> DataFrame:
    return op.article_total(op.topic_summary(articles(t)))


@BOOK.add(
    "a19_collection_summary",
    "SELECT 'session-' || lang AS research_session_id, count(*) AS articles_extracted, count(*) FILTER (source <> 'src3') AS articles_with_content FROM documents GROUP BY 1",
)
def _collected(t: Tables) -> DataFrame:
    blanked = articles(t).withColumn("content", F.when(F.col("source") == "src3", " \t ").otherwise(F.col("content")))
    return op.collection_summary(blanked)


@BOOK.add(
    "a19_store_outcomes",
    """SELECT 'session-' || lang AS research_session_id, count(*) FILTER (l.doc_id IS NULL AND source <> 'src3') AS stored, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped,
              count(*) FILTER (l.doc_id IS NULL AND source = 'src3') AS failed, count(*) FILTER (l.doc_id IS NOT NULL OR source <> 'src3') AS verified
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def _outcomes(t: Tables) -> DataFrame:
    rows = articles(t).withColumn("content", F.when(F.col("source") == "src3", "").otherwise(F.col("content")))
    stored = rows.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return op.store_outcomes(rows, stored)


@BOOK.add("f05_equal_ignoring_case", f"WITH {A} SELECT doc_id, source, impact FROM a WHERE lower(source) = 'src7' AND lower(coalesce(impact, 'neutral')) = 'neutral'")
def _equal(t: Tables) -> DataFrame:
    return op.filter_articles(articles(t), source="SRC7", impact="Neutral").select("doc_id", "source", "impact")


@BOOK.add("f05_topic_articles", f"WITH {A} SELECT doc_id FROM a WHERE topic = '' AND lower(impact) = 'positive'")
def _of_topic(t: Tables) -> DataFrame:
    return op.filter_articles(articles(t), topic="general news", impact="positive").select("doc_id")


@BOOK.add("f06_title_or_content", f"WITH {A} SELECT doc_id FROM a WHERE contains(lower(title), 'thster') OR contains(lower(content), 'thster')")
def _search(t: Tables) -> DataFrame:
    return op.filter_articles(articles(t), search="THster").select("doc_id")


@BOOK.add(
    "f07_date_range",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def _range(t: Tables) -> DataFrame:
    """Seven days before the newest event; the one-row maximum is read first."""
    as_of = t.events.agg(F.max("ts").alias("ts")).first()["ts"]
    recent = op.collected_within(t.events, "7d", F.lit(as_of).cast("timestamp_ntz"), "ts")
    return recent.select("event_id", "ts")


@BOOK.add("f08_article_lookup", f"WITH {A} SELECT doc_id, title, topic FROM a WHERE object_key = (SELECT max(object_key) FROM a)")
def _lookup(t: Tables) -> DataFrame:
    rows = articles(t)
    key = rows.agg(F.max("object_key").alias("k")).first()["k"]
    return lookup(rows, "object_key", key).select("doc_id", "title", "topic")


def stored_and_incoming(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labelled articles are stored already; all articles come in again with newer text."""
    rows = articles(t).select("object_key", "source", "title", "topic", "content", "collected_at", "research_session_id", "doc_id")
    stored = rows.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    fresh = rows.withColumn("title", F.concat(F.lit("new "), F.col("title")))
    return stored.drop("doc_id"), fresh.drop("doc_id")


_MERGE = """WITH {a}, k AS (SELECT object_key FROM a SEMI JOIN labels ON a.doc_id = labels.doc_id)
SELECT a.object_key, CASE WHEN k.object_key IS NOT NULL AND {keep} THEN title ELSE 'new ' || title END AS title, content FROM a LEFT JOIN k ON a.object_key = k.object_key"""


@BOOK.add("u04_upsert_keep", _MERGE.format(a=A, keep="true"))
def _keep(t: Tables) -> DataFrame:
    return merge_by_key(*stored_and_incoming(t), ["object_key"], "keep").select("object_key", "title", "content")


@BOOK.add("u04_upsert_replace", _MERGE.format(a=A, keep="false"))
def _replace(t: Tables) -> DataFrame:
    return merge_by_key(*stored_and_incoming(t), ["object_key"], "replace").select("object_key", "title", "content")


@BOOK.add("j04_skip_existing", f"WITH {A} SELECT object_key FROM a ANTI JOIN labels ON a.doc_id = labels.doc_id")
def _skip(t: Tables) -> DataFrame:
    stored, fresh = stored_and_incoming(t)
    return skip_existing(fresh, stored, ["object_key"]).select("object_key")


@BOOK.add("j05_delete_changed", f"WITH {A} SELECT doc_id FROM a WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 12000)")
def _delete(t: Tables) -> DataFrame:
    rows = articles(t)
    changed = t.documents.filter((F.col("lang") == "fr") & (F.col("n_chars") > 12000)).select("source").distinct()
    return rows.join(changed, "source", "left_anti").select("doc_id")


@BOOK.add(
    "k05_article_store",
    _MERGE.format(a=A, keep="true").replace("content FROM", "'src' || split_part(substring(source, 4), '/', 1) AS source_slug FROM"),
)
def _store(t: Tables) -> DataFrame:
    """Merge, write as JSON by source, read back."""
    path = run_folder(t.spark, "articles")
    write_article_store(store_articles(*stored_and_incoming(t)), path)
    return t.spark.read.schema("object_key string, title string, source_slug string").json(path)


@BOOK.add("k05_updated_store", _MERGE.format(a=A, keep="false"))
def _updated_store(t: Tables) -> DataFrame:
    """A store in place; articles that come in again replace the stored ones, in their buckets only."""
    path = run_folder(t.spark, "store")
    stored, fresh = stored_and_incoming(t)
    snapshots.write(stored, path, "object_key")
    snapshots.update(t.spark, path, latest_articles(fresh), "replace")
    return snapshots.read(t.spark, path).select("object_key", "title", "content")


@BOOK.add(
    "k05_session_summary",
    f"WITH {A} SELECT topic, research_session_id, count(*) AS article_count, max(collected_at) AS created_at FROM a GROUP BY 1, 2",
)
def _sessions(t: Tables) -> DataFrame:
    return op.session_summary(latest_articles(articles(t)))


@BOOK.add(
    "k06_index_upsert",
    """SELECT doc_id, source AS object_key, text FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 8000)
       UNION ALL SELECT doc_id, source, upper(lang) FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 8000)""",
)
def _index(t: Tables) -> DataFrame:
    """Every source is an object; the changed ones are indexed anew, the snapshot read back."""
    rows = t.documents.select("doc_id", F.col("source").alias("object_key"), "text", "lang", "n_chars")
    changed = rows.filter((F.col("lang") == "es") & (F.col("n_chars") > 8000)).select("object_key").distinct()
    updates = rows.join(changed, "object_key", "left_semi").select("doc_id", "object_key", F.upper("lang").alias("text"))
    return refresh_index(rows.select("doc_id", "object_key", "text"), updates, run_folder(t.spark, "index"))


@BOOK.add(
    "k06_updated_index",
    """SELECT doc_id, source AS object_key, text FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 8000)
       UNION ALL SELECT doc_id, source, upper(lang) FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 8000)""",
)
def _updated_index(t: Tables) -> DataFrame:
    """The same in place: all chunks of a changed object give way to its new ones."""
    path = run_folder(t.spark, "index")
    rows = t.documents.select("doc_id", F.col("source").alias("object_key"), "text", "lang", "n_chars")
    changed = rows.filter((F.col("lang") == "es") & (F.col("n_chars") > 8000)).select("object_key").distinct()
    updates = rows.join(changed, "object_key", "left_semi").select("doc_id", "object_key", F.upper("lang").alias("text"))
    snapshots.write(rows.select("doc_id", "object_key", "text"), path, "object_key")
    snapshots.update(t.spark, path, updates, "groups")
    return snapshots.read(t.spark, path).select("doc_id", "object_key", "text")


@BOOK.add(
    "g06_refilled_store",
    f"""WITH {SQL_ARTICLES} SELECT url, CASE WHEN page_id % 2 = 0 THEN 'old ' || title ELSE title END AS title,
          CASE WHEN page_id % 2 = 0 THEN 'session-1' ELSE 'session-2' END AS research_session_id FROM articles
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 2, page_id) = 1""",
)
def _refilled(t: Tables) -> DataFrame:
    """A second collection over a store that holds every other page: stored articles stay, new ones are added in place.

    Pages of one url are one article; the first collected counts.
    """
    return refilled_store(t).select("url", "title", "research_session_id")


@BOOK.add(
    "g06_filtered_store",
    f"""WITH {SQL_ARTICLES}, s AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN 'old ' || title ELSE title END AS title, content,
            TIMESTAMP '{START}' + page_id * INTERVAL 1 MINUTE AS collected_at FROM articles
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 2, page_id) = 1)
        SELECT url, title FROM s WHERE (contains(lower(title), 'ein') OR contains(lower(content), 'ein')) AND collected_at >= (SELECT max(collected_at) FROM s) - INTERVAL 1 DAY""",
)
def _filtered_store(t: Tables) -> DataFrame:
    """Search by words and time in the store that two collections have filled."""
    stored = refilled_store(t)
    newest = stored.agg(F.max("collected_at").alias("at")).first()["at"]
    found = op.filter_articles(stored, topic="general news", search="EIN", impact="neutral")
    return op.collected_within(found, "today", F.lit(newest).cast("timestamp_ntz")).select("url", "title")


def refilled_store(t: Tables) -> DataFrame:
    path = run_folder(t.spark, "newsroom")
    minutes = F.timestamp_add("MINUTE", F.col("page_id").cast("int"), F.lit(START).cast("timestamp_ntz"))
    session = F.when(F.col("page_id") % 2 == 0, "session-1").otherwise("session-2")
    found = collected_articles(t.pages, F.lit("latest news"), session, minutes)
    found = found.withColumn("object_key", F.sha2("url", 256))
    first = found.filter(F.col("research_session_id") == "session-1").withColumn("title", F.concat(F.lit("old "), F.col("title")))
    snapshots.write(latest_articles(first), path, "object_key")
    snapshots.update(t.spark, path, latest_articles(found), "keep")
    return snapshots.read(t.spark, path)


@BOOK.add(
    "g06_news_store_topics",
    f"""WITH {SQL_ARTICLES}, s AS (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'Secure Web' ELSE 'General News' END AS topic FROM articles)
        SELECT topic, count(*) AS article_count, CAST(0 AS BIGINT) AS positive, CAST(0 AS BIGINT) AS negative, count(*) AS neutral, TIMESTAMP '2024-01-01 00:00:00' AS last_updated FROM s GROUP BY 1""",
)
def _newsroom(t: Tables) -> DataFrame:
    """Extract all pages, store over an empty store, roll up by topic."""
    query = F.when(F.startswith("url", F.lit("https:")), "berita secure web hari ini").otherwise("latest news")
    when = F.lit(START).cast("timestamp_ntz")
    incoming = collected_articles(t.pages, query, F.lit("session-1"), when)
    empty = t.spark.createDataFrame([], incoming.schema)
    return refresh_store(empty, incoming)[1]
