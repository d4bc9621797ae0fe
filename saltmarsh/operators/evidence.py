"""Evidence records: coalescing, projection for display, rendering, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.functions.numbers import coerce_double, coerce_int
from saltmarsh.functions.text import strip
from saltmarsh.functions.urls import host
from saltmarsh.functions.values import filled as nonempty
from saltmarsh.operators.ranking import SOURCE_THRESHOLD
from saltmarsh.operators.rows import first_per_key, number_rows

METADATA = "struct<content:string,text:string,document_id:string,document_name:string,title:string,filename:string,object_key:string,bucket:string,url:string,page:string,relevance:string,relevance_score:string,source_type:string>"
EVIDENCE = (
    "content string, text string, snippet string, document string, chunk string, document_id string, "
    "id string, document_name string, title string, filename string, page string, relevance string, "
    "relevance_score string, object_key string, bucket string, url string, metadata " + METADATA
)


def filled(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalise_evidence(df: DataFrame, record: str = "record") -> DataFrame:
    """One shape for records of differing spelling; records without content are dropped."""
    keep = [c for c in df.columns if c != record]

    def shape(r: Column) -> Column:
        m = r["metadata"]
        own = strip(filled(r["content"], r["text"], r["snippet"], r["document"], r["chunk"]))
        content = F.coalesce(nonempty(own), nonempty(strip(filled(m["content"], m["text"]))))
        key = filled(m["object_key"], r["object_key"])
        names = [r["document_name"], r["title"], r["filename"], m["document_name"], m["title"], m["filename"]]
        return F.struct(
            content.alias("content"),
            filled(r["document_id"], r["id"], m["document_id"], key).alias("document_id"),
            filled(*names, F.lit("internal_document")).alias("document_name"),
            coerce_int(F.coalesce(r["page"], m["page"])).alias("page"),
            coerce_double(F.coalesce(r["relevance"], r["relevance_score"], m["relevance"], m["relevance_score"])).alias("relevance"),
            filled(m["url"], r["url"]).alias("url"),
            filled(m["bucket"], r["bucket"]).alias("bucket"),
            key.alias("object_key"),
        )

    shaped = F.transform(F.array(F.col(record)), shape)
    rows = df.select(*keep, F.inline(F.filter(shaped, lambda s: s["content"].isNotNull())))
    unnamed = F.concat(F.lit("rag-"), F.substring(F.sha2("content", 256), 1, 12))
    return rows.withColumn("document_id", F.coalesce("document_id", unnamed))


def parse_evidence(df: DataFrame, json: str = "json") -> DataFrame:
    keep = [c for c in df.columns if c != json]
    return normalise_evidence(df.select(*keep, F.from_json(json, EVIDENCE).alias("record")))


def display_sources(df: DataFrame) -> DataFrame:
    """Source card of a record: title, type, storage, host, page, relevance, snippet."""
    col = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    return df.select(
        *[c for c in ("query_id", "doc_id", "page_id") if c in df.columns],
        filled(col("filename"), col("title"), col("source"), F.lit("Unknown source")).alias("title"),
        F.coalesce(col("source_type"), F.lit("internal_document")).alias("source_type"),
        F.when(filled(col("bucket")).isNotNull(), "minio").alias("storage"),
        filled(col("object_key")).alias("object_key"),
        coerce_int(col("page")).alias("page"),
        F.coalesce(col("relevance_score").try_cast("double"), col("gaussian_score").try_cast("double"), F.lit(0.0)).alias("relevance"),
        col("url").alias("url"),
        host(col("url")).alias("domain"),
        F.when(filled(col("content")).isNotNull(), F.concat(F.substring(col("content"), 1, 150), F.lit("..."))).alias("snippet"),
    )


def good_sources(df: DataFrame, order: Sequence[str], threshold: float = SOURCE_THRESHOLD) -> DataFrame:
    """Sources with an identity and enough relevance, the first of each identity."""
    identity = filled(*[F.col(c) for c in ("object_key", "url", "filename", "title") if c in df.columns])
    kept = df.withColumn("identity", identity).filter(
        F.col("identity").isNotNull() & (F.coalesce("relevance", F.lit(0.0)) >= threshold)
    )
    return first_per_key(kept, ["identity"], [F.col(c) for c in order])


def render_context(df: DataFrame, rank: str = "rank") -> Column:
    """Text block of one retrieved record."""
    col = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)
    name = filled(*[F.col(c) for c in ("filename", "title", "source") if c in df.columns], F.lit("unknown"))
    relevance = F.coalesce(F.col("relevance_score"), F.lit(0.0)) if "relevance_score" in df.columns else F.lit(0.0)
    return F.concat(
        F.lit("\n[SOURCE "), F.col(rank).cast("string"), F.lit("]\nFile: "), name,
        F.lit("\nBucket: "), col("bucket", "unknown"),
        F.lit("\nObject key: "), col("object_key", "unknown"),
        F.lit("\nPage: "), col("page", "0"),
        F.lit("\nChunk: "), col("chunk", "0"),
        F.lit("\nRelevance: "), F.format_string("%.6f", relevance),
        F.lit("\n\nContent:\n"), F.col("text"), F.lit("\n"),
    )


def context_text(top: DataFrame, rank: str = "rank", keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Blocks of each query's top-k records in rank order; k bounds the group."""
    blocks = top.select(*keys, F.struct(F.col(rank).alias("r"), render_context(top, rank).alias("block")).alias("b"))
    ordered = F.sort_array(F.collect_list("b"))
    return blocks.groupBy(*keys).agg(F.array_join(ordered["block"], "\n").alias("context"))


def render_article(number: Column, published: Column, author: Column) -> Column:
    """Text block of one collected article (title, source, url, category, content columns)."""
    line = lambda label, value: F.concat(F.lit(label + ": "), F.coalesce(value, F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("NEWS "), number.cast("string")),
        F.lit(""),
        line("Title", F.col("title")),
        line("Source", F.col("source")),
        line("Published", published),
        line("URL", F.col("url")),
        line("Author", author),
        line("Category", F.col("category")),
        F.lit(""),
        F.lit("Content:"),
        F.coalesce(F.col("content"), F.lit("")),
    )


def number_evidence(df: DataFrame, order: Sequence[str], session: Column) -> DataFrame:
    """Sequential ids evidence_001, evidence_002, ... in result order, with the session id."""
    numbered = number_rows(df, order, "_n")
    label = F.concat(F.lit("evidence_"), F.lpad((F.col("_n") + 1).cast("string"), 3, "0"))
    long = F.concat(F.lit("evidence_"), (F.col("_n") + 1).cast("string"))
    return numbered.select(
        F.when(F.col("_n") < 999, label).otherwise(long).alias("evidence_id"),
        session.alias("research_session_id"),
        *df.columns,
    )


def zip_by_position(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pair array elements by position; the longer array decides the length."""
    keep = [c for c in df.columns if c not in (left, right)]
    pairs = F.arrays_zip(left, right)
    return df.select(*keep, F.posexplode(pairs).alias("position", "pair")).select(
        *keep, "position", F.col("pair")[left].alias(left), F.col("pair")[right].alias(right)
    )


def first_object_per_url(objects: DataFrame, position: str = "position") -> DataFrame:
    return objects.groupBy("url").agg(F.min_by("object_key", F.col(position)).alias("object_key"))


def with_object_key(articles: DataFrame, objects: DataFrame, position: str = "position") -> DataFrame:
    return articles.join(first_object_per_url(objects, position), "url", "left")
