"""Object scans: article JSON, text objects, nested customs documents, job catalogue.

Each scan has a reader (files to ``path, value`` rows) and a transform that works
on such rows, so objects that already sit in a table take the same way.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from saltmarsh.functions import text as tx, urls

ARTICLE = (
    "evidence_id string, research_session_id string, request_id string, title string, source string, "
    "category string, author string, published_at string, url string, content string, relevance_score double, "
    "query string, topic string, artifact_id string, source_type string, storage string, impact string, "
    "collected_at string"
)
EXTERNAL = "external_news"
TEXT_SUFFIXES = ("txt", "md", "csv", "json")

CUSTOMS_DOCUMENT = """
document struct<document_type:string,ppbj_number:string,document_date:string>,
transaction struct<object:string,type:string,origin_destination:string>,
company struct<name:string,npwp:string,address:string,registered_kpp:string,kpbpb:string>,
counterparty struct<name:string,npwp_nik:string,address:string,registered_kpp:string>,
contract struct<number:string,date:string>,
items array<struct<page:int,item_number:int,type:string,hs_code:string,description:string,transaction_value:double>>,
`values` struct<total_transaction_value:double,tax_base:double,down_payment:double,vat_or_luxury_tax:double,vat_or_luxury_tax_facility:double>,
payment struct<account_number:string,account_name:string,bank_name:string>,
pages array<struct<page:int,sections:array<string>>>
"""

DEFAULT_STAGES = ("bronze", "silver", "gold", "forecast")


def read_objects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row per file: path and whole text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def relative_key(path: Column, bucket: str) -> Column:
    """Object key below the bucket folder."""
    marker = f"/{bucket}/"
    at = F.instr(path, marker)
    return F.when(at > 0, F.substr(path, at + len(marker))).otherwise(path)


def stored_articles(objects: DataFrame, bucket: str = "news") -> DataFrame:
    """Stored external articles. Unreadable objects are skipped, topic and id get defaults."""
    keyed = objects.filter(F.endswith("path", F.lit(".json"))).select(
        relative_key(F.col("path"), bucket).alias("object_key"),
        F.from_json("value", ARTICLE).alias("a"),
        F.json_object_keys("value").alias("_keys"),
    )
    rows = keyed.filter(F.col("a.source_type") == EXTERNAL).select("a.*", "object_key", "_keys")
    has = lambda name: F.array_contains("_keys", F.lit(name))
    return rows.withColumns(
        {
            "bucket": F.lit(bucket),
            "topic": F.when(has("topic"), F.col("topic")).otherwise(F.lit(tx.DEFAULT_TOPIC)),
            "artifact_id": F.when(has("artifact_id"), F.col("artifact_id")).otherwise(urls.file_stem(F.col("object_key"))),
        }
    ).drop("_keys")


def articles_to_index(objects: DataFrame, bucket: str = "news") -> DataFrame:
    """Articles with stripped, non-empty content, ready for chunking."""
    parsed = objects.filter(F.endswith("path", F.lit(".json"))).select(
        relative_key(F.col("path"), bucket).alias("object_key"), F.from_json("value", ARTICLE).alias("a")
    )
    rows = parsed.select(
        "object_key",
        urls.file_name(F.col("object_key")).alias("filename"),
        F.coalesce("a.source", F.lit("Unknown")).alias("source"),
        *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("category", "author", "url", "title")],
        tx.strip(F.col("a.content")).alias("content"),
    )
    return rows.filter(F.col("content") != "")


def _indent(texts: pd.Series) -> pd.Series:
    """JSON written out with two blanks of indent, members in their own order; other text unchanged."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except ValueError:
            return text

    return texts.map(one)


def text_objects(binaries: DataFrame, bucket: str = "documents") -> DataFrame:
    """Text of supported objects: bad bytes replaced, JSON written out with indent; page 0."""
    key = relative_key(F.col("path"), bucket)
    suffix = urls.extension(key)
    rows = binaries.filter(suffix.isin(*TEXT_SUFFIXES)).select(
        key.alias("object_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )
    is_json = urls.extension(F.col("object_key")) == "json"
    # One pass: other objects enter Python as null.
    indented = F.pandas_udf(_indent, T.StringType())(F.when(is_json, F.col("text")))
    return rows.select(
        "object_key",
        urls.file_name(F.col("object_key")).alias("filename"),
        urls.file_stem(F.col("object_key")).alias("document_type"),
        urls.content_type(F.col("object_key")).alias("content_type"),
        F.lit(0).alias("page"),
        F.coalesce(indented, "text").alias("text"),
    )


def customs_documents(objects: DataFrame) -> DataFrame:
    parsed = objects.select("path", F.from_json("value", CUSTOMS_DOCUMENT).alias("d"))
    return parsed.filter(F.col("d").isNotNull()).select("path", "d.*")


def document_items(documents: DataFrame, key: str = "path") -> DataFrame:
    """One row per item of a nested document."""
    return documents.select(key, F.explode("items").alias("item")).select(key, "item.*")


def item_totals(documents: DataFrame, key: str = "path") -> DataFrame:
    """Sum of the items beside the stated total of each document.

    The sum is taken inside the row, so no shuffle is needed.
    """
    total = F.aggregate(
        "items", F.lit(0.0), lambda s, item: s + F.coalesce(item["transaction_value"], F.lit(0.0))
    )
    stated = F.col("values.total_transaction_value")
    return documents.select(
        key,
        F.size("items").alias("item_count"),
        total.alias("items_total"),
        stated.alias("stated_total"),
        (F.abs(total - stated) < 0.005).alias("matches"),
    )


def list_keys(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """Object keys below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(relative_key(F.col("path"), bucket).alias("key"))


def job_catalogue(keys: DataFrame, manifests: DataFrame) -> DataFrame:
    """Jobs found under ``jobs/`` with source file, creation time and stage names.

    ``manifests`` has job_id and the manifest JSON text; jobs without one get the default stages.
    """
    parts = F.split("key", "/")
    jobs = keys.filter(F.startswith("key", F.lit("jobs/")) & (F.size(parts) > 2)).select(parts[1].alias("job_id"))
    jobs = jobs.filter(F.col("job_id") != "").distinct()
    described = manifests.select(
        "job_id",
        F.get_json_object("manifest", "$.source_file").alias("source_file"),
        F.get_json_object("manifest", "$.created_at").alias("created_at"),
        F.json_object_keys(F.get_json_object("manifest", "$.stages")).alias("stages"),
    )
    default = F.array(*[F.lit(s) for s in DEFAULT_STAGES])
    return jobs.join(described, "job_id", "left").withColumn("stages", F.coalesce("stages", default))
