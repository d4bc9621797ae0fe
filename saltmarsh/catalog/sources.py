"""Scans and sinks: the given tables written in each format and read back, and streams over them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.catalog.activity import _CLOSED, _STATES, activity_events
from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.cleaning import _GAPS, orders_with_gaps
from saltmarsh.operators.cleaning import sanitise_numbers
from saltmarsh.plans.medallion import full_run, raw_to_bronze, silver_to_gold
from saltmarsh.scratch import run_folder
from saltmarsh.sources import documents as docs, sinks, tables as tb
from saltmarsh.sources.workbook import read_workbooks, workbook_columns, workbook_rows
from saltmarsh.streaming.activity import (
    execution_stream, kept_executions, latest_states, state_stream, unique_stream, write_retained, write_states,
)
from saltmarsh.streaming import unique
from saltmarsh.streaming.ingest import ingest_files, read_silver

BOOK = Book()

_ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


def plain_orders(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
    )


@BOOK.add("s01_csv_typed", _ORDER_SQL)
def _csv(t: Tables) -> DataFrame:
    path = run_folder(t.spark, "orders-csv")
    sinks.write_table(t.orders, path, "csv")
    return plain_orders(tb.read_csv(t.spark, path))


@BOOK.add("s02_csv_late_typed", "SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS INTEGER) AS unitssold, o_orderstatus FROM orders")
def _csv_text(t: Tables) -> DataFrame:
    path = run_folder(t.spark, "orders-text")
    noisy = t.orders.select(
        "o_orderkey",
        F.concat(F.col("o_totalprice").cast("string"), F.lit(" usd")).alias("price"),
        F.format_number("o_custkey", 0).alias("unitssold"),
        "o_orderstatus",
    )
    sinks.write_table(noisy, path, "csv")
    typed = sanitise_numbers(tb.read_csv(t.spark, path, typed=False), {"price": "double", "unitssold": "int"})
    return typed.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@BOOK.add("s03_parquet_parts", "SELECT * FROM customer")
def _parquet(t: Tables) -> DataFrame:
    path = run_folder(t.spark, "customer-parts")
    sinks.write_table(t.customer.repartition("c_nationkey"), path)
    return tb.read_table(t.spark, path, "parquet")


def _workbook(rows: pd.DataFrame) -> bytes:
    """A workbook with a notes sheet first and the rows on a sales sheet."""

    def sheet(lines: list[list[str]]) -> str:
        cells = ["".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in line) for line in lines]
        body = "".join(f"<row>{line}</row>" for line in cells)
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/>'
            '<sheet name="Mobile Sales" sheetId="2" r:id="rId2"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", sheet([["nothing here"]]))
        book.writestr("xl/worksheets/sheet2.xml", sheet([list(rows.columns), *rows.astype(str).values.tolist()]))
    return out.getvalue()


def part_workbooks(t: Tables) -> DataFrame:
    """The parts as workbooks of at most 5000 rows, one binary row per workbook."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        name = f"parts-{frame['book'].iloc[0]}.xlsx"
        return pd.DataFrame({"path": [name], "content": [_workbook(frame.drop(columns="book"))]})

    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", F.floor(F.col("p_partkey") / 5000).alias("book"))
    return rows.groupBy("book").applyInPandas(build, "path string, content binary")


@BOOK.add("s04_workbooks", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _workbooks(t: Tables) -> DataFrame:
    files = part_workbooks(t)
    rows = workbook_rows(files, workbook_columns(files))
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"))


def save_workbooks(files: DataFrame, path: str) -> None:
    """Each workbook as a file of the folder, written by the task that made it."""

    def save(frames):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder)
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield frame[["path"]]

    files.mapInPandas(save, "path string").write.format("noop").mode("overwrite").save()


@BOOK.add("s04_scanned_workbooks", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _scanned_workbooks(t: Tables) -> DataFrame:
    """The same workbooks from a folder."""
    path = run_folder(t.spark, "workbooks")
    save_workbooks(part_workbooks(t), path)
    rows = read_workbooks(t.spark, path)
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"))


@BOOK.add("s05_folder_with_workbooks", "SELECT p_partkey, p_name, CASE WHEN p_partkey < 5000 THEN p_size END AS p_size FROM part")
def _folder_with_workbooks(t: Tables) -> DataFrame:
    """A folder of workbooks, Parquet and CSV files; two of the three hold a column less."""
    path = run_folder(t.spark, "mixed-books")
    save_workbooks(part_workbooks(t).filter("path = 'parts-0.xlsx'"), f"{path}/books")
    rest = t.part.filter("p_partkey >= 5000").select("p_partkey", "p_name")
    sinks.write_table(rest.filter("p_partkey % 2 = 0"), f"{path}/even")
    sinks.write_table(rest.filter("p_partkey % 2 = 1"), f"{path}/odd", "csv")
    rows = tb.read_folder(t.spark, path)
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@BOOK.add(
    "s05_mixed_folder",
    "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders",
)
def _mixed(t: Tables) -> DataFrame:
    """One status as Parquet, one as CSV, one as CSV with a column less."""
    path = run_folder(t.spark, "mixed")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    of = lambda s: rows.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")
    sinks.write_table(of("F"), f"{path}/finished")
    sinks.write_table(of("O"), f"{path}/open", "csv")
    sinks.write_table(of("P").withColumn("o_orderpriority", F.lit(None).cast("string")), f"{path}/pending", "csv")
    found = tb.read_folder(t.spark, path)
    return found.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


def article_objects(t: Tables) -> DataFrame:
    """Documents as stored article objects: German ones unreadable, Spanish ones internal, French ones with topic."""
    doc = F.col("doc_id").cast("string")
    kind = lambda name: F.when(F.col("lang") == name, F.lit("internal")).otherwise(docs.EXTERNAL).alias("source_type")
    full = F.to_json(F.struct("source", F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("content"), kind("es")))
    named = F.to_json(F.struct("source", "lang", F.col("text").alias("content"), kind("es"), F.lit("Bourse").alias("topic"), doc.alias("artifact_id")))
    value = F.when(F.col("lang") == "de", F.concat(F.lit("{bad "), doc)).when(F.col("lang") == "fr", named).otherwise(full)
    path = F.concat(F.lit("file:/store/news/"), F.col("source"), F.lit("/d-"), doc, F.lit(".json"))
    return t.documents.select(path.alias("path"), value.alias("value"))


@BOOK.add(
    "s06_stored_articles",
    """SELECT source || '/d-' || doc_id || '.json' AS object_key, 'news' AS bucket, CASE lang WHEN 'fr' THEN 'Bourse' ELSE 'General News' END AS topic,
              CASE lang WHEN 'fr' THEN CAST(doc_id AS VARCHAR) ELSE 'd-' || doc_id END AS artifact_id FROM documents WHERE lang NOT IN ('de', 'es')""",
)
def _stored(t: Tables) -> DataFrame:
    return docs.stored_articles(article_objects(t)).select("object_key", "bucket", "topic", "artifact_id")


@BOOK.add(
    "s07_articles_to_index",
    r"""SELECT source || '/d-' || doc_id || '.json' AS object_key, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
        FROM documents WHERE lang <> 'de'""",
)
def _to_index(t: Tables) -> DataFrame:
    return docs.articles_to_index(article_objects(t)).select("object_key", "source", "content")


@BOOK.add(
    "s08_text_objects",
    """SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.json' ELSE '.md' END AS object_key,
              CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'application/json' ELSE 'text/markdown' END AS content_type,
              CASE lang WHEN 'en' THEN text || chr(65533) WHEN 'de' THEN '{' || chr(10) || '  "text": ' || to_json(text) || chr(10) || '}' ELSE text END AS text
       FROM documents WHERE lang <> 'fr'""",
)
def _text_objects(t: Tables) -> DataFrame:
    """English text with a broken byte, German as JSON, French with an unsupported suffix."""
    lang = F.col("lang")
    suffix = F.when(lang == "en", ".txt").when(lang == "de", ".json").when(lang == "fr", ".png").otherwise(".md")
    path = F.concat(F.lit("file:/store/documents/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    plain = F.encode("text", "UTF-8")
    broken = F.concat(plain, F.unhex(F.lit("FF")))
    content = F.when(lang == "en", broken).when(lang == "de", F.encode(F.to_json(F.struct("text")), "UTF-8")).otherwise(plain)
    return docs.text_objects(t.documents.select(path.alias("path"), content.alias("content"))).select("object_key", "content_type", "text")


def customs_objects(t: Tables) -> DataFrame:
    """A nested customs document per document: one item per line, its value the line length."""
    lines = F.split("text", "\n")
    items = F.transform(
        lines,
        lambda line, i: F.struct(F.lit(1).alias("page"), (i + 1).alias("item_number"), line.alias("description"), F.length(line).alias("transaction_value")),
    )
    total = F.aggregate(lines, F.lit(0), lambda s, line: s + F.length(line))
    stated = F.when(F.col("lang") == "de", total + 1).otherwise(total)
    value = F.to_json(
        F.struct(
            F.struct(F.lit("invoice").alias("document_type"), F.col("source").alias("ppbj_number")).alias("document"),
            items.alias("items"),
            F.struct(stated.alias("total_transaction_value")).alias("values"),
        )
    )
    return t.documents.select(F.col("doc_id").cast("string").alias("path"), value.alias("value"))


@BOOK.add(
    "s09_customs_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS path, source AS number, len(string_split(text, chr(10))) AS items FROM documents",
)
def _customs(t: Tables) -> DataFrame:
    parsed = docs.customs_documents(customs_objects(t))
    return parsed.select("path", F.col("document.ppbj_number").alias("number"), F.size("items").cast("bigint").alias("items"))


@BOOK.add(
    "p15_exploded_items",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS INTEGER) AS item_number, line AS description, CAST(length(line) AS DOUBLE) AS transaction_value
       FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)""",
)
def _items(t: Tables) -> DataFrame:
    items = docs.document_items(docs.customs_documents(customs_objects(t)))
    return items.select("path", "item_number", "description", "transaction_value")


@BOOK.add(
    "p15_item_totals",
    """WITH s AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
            v AS (SELECT doc_id, lang, len(l) AS n, CAST(list_sum(list_transform(l, lambda x: length(x))) AS DOUBLE) AS s FROM s)
       SELECT CAST(doc_id AS VARCHAR) AS path, CAST(n AS INTEGER) AS item_count, s AS items_total, CASE lang WHEN 'de' THEN s + 1 ELSE s END AS stated_total, lang <> 'de' AS matches FROM v""",
)
def _totals(t: Tables) -> DataFrame:
    return docs.item_totals(docs.customs_documents(customs_objects(t)))


@BOOK.add(
    "s10_job_catalogue",
    """SELECT DISTINCT source AS job_id, CASE WHEN source LIKE 'src1%' THEN source || '.csv' END AS source_file,
              CASE WHEN source LIKE 'src1%' THEN '2024-01-01' END AS created_at, CASE WHEN source LIKE 'src1%' THEN 'bronze,gold' ELSE 'bronze,silver,gold,forecast' END AS stages FROM documents""",
)
def _jobs(t: Tables) -> DataFrame:
    """Documents as objects of jobs named after their source; some jobs have a manifest. Listed in id order."""
    keys = t.documents.select(F.concat_ws("/", F.lit("jobs"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".json"))).alias("key"))
    manifest = F.concat(F.lit('{"source_file":"'), F.col("source"), F.lit('.csv","created_at":"2024-01-01","stages":{"bronze":{},"gold":{}}}'))
    described = t.documents.filter(F.startswith("source", F.lit("src1"))).select(F.col("source").alias("job_id"), manifest.alias("manifest")).distinct()
    return docs.job_catalogue(keys, described).withColumn("stages", F.array_join("stages", ",")).orderBy("job_id")


# Folders over which the objects of a bucket are spread.
FOLDERS = 16
# Objects that one task writes, about.
TASK_OBJECTS = 2000


def save_objects(objects: DataFrame, path: str) -> None:
    """Each value of (folder, value) rows as a JSON file of its own, below its folder, written by as many tasks as the rows need."""

    def save(frames):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(path)
        task, number, made = TaskContext.get().partitionId(), 0, set()
        for frame in frames:
            for folder, value in zip(frame["folder"], frame["value"]):
                if folder not in made:
                    system.create_dir(f"{base}/{folder}")
                    made.add(folder)
                # Rows come in a fixed order, so a repeated task writes the same files.
                with system.open_output_stream(f"{base}/{folder}/part-{task:05d}-{number:06d}.json") as out:
                    out.write(f"{value}\n".encode())
                number += 1
            yield frame[["folder"]]

    tasks = max(objects.sparkSession.sparkContext.defaultParallelism, -(-objects.count() // TASK_OBJECTS))
    dealt = objects.repartition(tasks, "folder", "value").sortWithinPartitions("folder", "value")
    dealt.mapInPandas(save, "folder string").write.format("noop").mode("overwrite").save()


def supplier_files(t: Tables, bucket: str, *columns: Column, folders: int | None = FOLDERS) -> str:
    """One JSON file per supplier in a few folders of a bucket, or in a folder each; the folder that holds the bucket."""
    base = run_folder(t.spark, "objects")
    number = F.col("s_suppkey") if folders is None else F.col("s_suppkey") % folders
    named = F.concat(F.lit("supplier="), F.coalesce(number.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    save_objects(t.supplier.select(named.alias("folder"), F.to_json(F.struct(*columns)).alias("value")), f"{base}/{bucket}")
    return base


def supplier_articles(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 5 == 0, "internal").otherwise(docs.EXTERNAL).alias("source_type")
    text = F.concat(F.lit("  About "), F.col("s_name"), F.lit(" ")).alias("content")
    base = supplier_files(t, "news", F.col("s_name").alias("title"), F.lit("Wire").alias("source"), text, kind)
    return docs.read_objects(t.spark, base)


@BOOK.add("s06_scanned_articles", "SELECT s_name AS title, 'General News' AS topic, 'supplier=' || (s_suppkey % 16) AS folder FROM supplier WHERE s_suppkey % 5 <> 0")
def _scanned_articles(t: Tables) -> DataFrame:
    found = docs.stored_articles(supplier_articles(t))
    return found.select("title", "topic", F.split_part("object_key", F.lit("/"), F.lit(1)).alias("folder"))


@BOOK.add("s07_scanned_index_articles", "SELECT s_name AS title, 'About ' || s_name AS content FROM supplier")
def _scanned_to_index(t: Tables) -> DataFrame:
    return docs.articles_to_index(supplier_articles(t)).select("title", "content")


@BOOK.add(
    "s08_scanned_texts",
    """SELECT 'supplier=' || (s_suppkey % 16) AS folder, 'application/json' AS content_type,
              '{' || chr(10) || '  "s_name": "' || s_name || '"' || chr(10) || '}' AS text FROM supplier""",
)
def _scanned_texts(t: Tables) -> DataFrame:
    found = docs.text_objects(docs.read_binaries(t.spark, supplier_files(t, "documents", F.col("s_name"))))
    return found.select(F.split_part("object_key", F.lit("/"), F.lit(1)).alias("folder"), "content_type", "text")


@BOOK.add("s09_scanned_customs", "SELECT s_name AS number, s_acctbal AS amount, 2 AS items FROM supplier")
def _scanned_customs(t: Tables) -> DataFrame:
    item = F.struct(F.lit(1).alias("page"), F.col("s_acctbal").alias("transaction_value"))
    base = supplier_files(t, "customs", F.struct(F.col("s_name").alias("ppbj_number")).alias("document"), F.array(item, item).alias("items"))
    found = docs.customs_documents(docs.read_objects(t.spark, base))
    return found.select(F.col("document.ppbj_number").alias("number"), F.col("items")[0]["transaction_value"].alias("amount"), F.size("items").alias("items"))


@BOOK.add("s10_listed_jobs", "SELECT 'supplier=' || s_suppkey AS job_id, 'bronze,silver,gold,forecast' AS stages FROM supplier")
def _listed_jobs(t: Tables) -> DataFrame:
    """Every supplier is a job with a folder of its own."""
    base = supplier_files(t, "store/jobs", F.col("s_name"), folders=None)
    none = t.supplier.limit(0).select(F.col("s_name").alias("job_id"), F.col("s_name").alias("manifest"))
    found = docs.job_catalogue(docs.list_keys(t.spark, base, "store"), none)
    return found.select("job_id", F.array_join("stages", ",").alias("stages"))


@BOOK.add(
    "j09_jobs_with_manifest",
    "SELECT source AS job_id, count(*) AS objects, CASE WHEN source LIKE 'src1%' THEN source || '.csv' END AS source_file FROM documents GROUP BY 1",
)
def _job_manifest(t: Tables) -> DataFrame:
    """Objects are counted per job before the join, so a job with most objects joins as one row."""
    counted = t.documents.groupBy(F.col("source").alias("job_id")).agg(F.count(F.lit(1)).alias("objects"))
    named = t.documents.select("source").distinct().filter(F.startswith("source", F.lit("src1")))
    manifests = named.select(F.col("source").alias("job_id"), F.concat("source", F.lit(".csv")).alias("source_file"))
    return counted.join(manifests, "job_id", "left")


@BOOK.add("k01_written_tables", "SELECT 'csv' AS format, p_partkey, p_name FROM part UNION ALL SELECT 'parquet', p_partkey, p_name FROM part")
def _written(t: Tables) -> DataFrame:
    base = run_folder(t.spark, "written")
    rows = t.part.select("p_partkey", "p_name")
    sinks.write_table(rows, f"{base}/csv", "csv", compression="gzip")
    sinks.write_table(rows, f"{base}/parquet", "parquet", compression="zstd")
    back = [
        tb.read_csv(t.spark, f"{base}/csv", schema="p_partkey bigint, p_name string").select(F.lit("csv").alias("format"), "p_partkey", "p_name"),
        tb.read_parquet(t.spark, f"{base}/parquet").select(F.lit("parquet").alias("format"), "p_partkey", "p_name"),
    ]
    return back[0].unionByName(back[1])


@BOOK.add("k03_verified_write", "SELECT count(*) AS rows_sent, count(*) AS rows_stored, true AS verified FROM lineitem")
def _verified(t: Tables) -> DataFrame:
    return sinks.verified_write(t.lineitem, run_folder(t.spark, "verified"))


@BOOK.add(
    "k04_layer_metadata",
    f"""SELECT 'silver' AS layer, count(*) AS row_count, 4 AS column_count, '["transactionid", "date", "price", "totalrevenue"]' AS columns,
               count(*) FILTER (date IS NULL) + count(*) FILTER (price IS NULL) + count(*) FILTER (totalrevenue IS NULL) AS missing_values, 'completed' AS status FROM {_GAPS}""",
)
def _metadata(t: Tables) -> DataFrame:
    meta = sinks.layer_metadata(orders_with_gaps(t), "silver", "job-1", "bronze/data", "silver/data")
    return meta.select("layer", "row_count", "column_count", "columns", "missing_values", "status")


@BOOK.add(
    "k04_manifest",
    """SELECT 'job-1' AS job_id, 'part.csv' AS source_file, 'bronze' AS stage, count(*) AS rows, 'completed' AS status FROM part
       UNION ALL SELECT 'job-1', 'part.csv', 'silver', count(*), 'completed' FROM part WHERE p_size > 10""",
)
def _manifest(t: Tables) -> DataFrame:
    """The manifest of two stages, written and read back."""
    path = run_folder(t.spark, "manifest")
    layers = {"bronze": t.part, "silver": t.part.filter("p_size > 10")}
    stages = {
        name: {"rows": sinks.verified_write(rows, f"{path}/{name}").first()["rows_stored"], "status": "completed"} for name, rows in layers.items()
    }
    sinks.write_manifest(t.spark, f"{path}/manifest", "job-1", "part.csv", "2024-01-01T00:00:00Z", stages)
    return sinks.read_manifest(t.spark, f"{path}/manifest").select("job_id", "source_file", "stage", "rows", "status")


def raw_sales(t: Tables) -> DataFrame:
    """Orders as a raw sales file with noise in the numbers and two date spellings."""
    date = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("TransactionID"),
        date.alias("Date"),
        F.concat(F.format_number("o_totalprice", 2), F.lit(" usd")).alias("Price"),
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_totalprice").cast("string")).alias("TotalRevenue"),
        F.concat(F.pmod("o_custkey", F.lit(9)).cast("string"), F.lit("pcs")).alias("Units_Sold"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("Location"),
    )


def raw_folder(t: Tables) -> str:
    path = run_folder(t.spark, "raw")
    sinks.write_table(raw_sales(t), path, "csv")
    return path


@BOOK.add(
    "g01_bronze_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS TransactionID, o_totalprice AS Price, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS TotalRevenue,
              CAST(o_custkey % 9 AS INTEGER) AS Units_Sold, true AS lineage FROM orders""",
)
def _bronze(t: Tables) -> DataFrame:
    base = run_folder(t.spark, "bronze")
    raw_to_bronze(t.spark, raw_folder(t), base)
    stamped = F.col("source_file").isNotNull() & F.col("ingestion_timestamp").isNotNull()
    return t.spark.read.parquet(base).select("TransactionID", "Price", "TotalRevenue", "Units_Sold", stamped.alias("lineage"))


_FULL = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 4) AS total_sales,
  CAST(sum(o_custkey % 9) AS BIGINT) AS total_quantity FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""


@BOOK.add(
    "g03_gold_from_silver",
    """SELECT 'location' AS kind, o_orderpriority AS key, round(sum(o_totalprice), 4) AS total_sales, CAST(sum(o_custkey % 9) AS BIGINT) AS total_quantity
         FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2
       UNION ALL SELECT 'date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), round(sum(o_totalprice), 4), CAST(sum(o_custkey % 9) AS BIGINT)
         FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2""",
)
def _gold_only(t: Tables) -> DataFrame:
    """A silver table that is there already; two of its gold tables are read back."""
    base = run_folder(t.spark, "gold-only")
    silver = t.orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("transactionid"), F.to_date("o_orderdate").alias("date"), F.lit("any").alias("mobilemodel"),
        F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("totalrevenue"),
        F.pmod("o_custkey", F.lit(9)).cast("int").alias("unitssold"), F.col("o_orderpriority").alias("location"),
    )
    sinks.write_table(silver, f"{base}/silver")
    paths = silver_to_gold(t.spark, f"{base}/silver", f"{base}/gold")
    parts = [
        t.spark.read.parquet(paths[table]).select(
            F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("key"), F.round("total_sales", 4).alias("total_sales"), "total_quantity"
        )
        for table, kind in (("sales_by_location", "location"), ("daily_sales", "date"))
    ]
    return parts[0].unionByName(parts[1])


@BOOK.add("g04_full_run", _FULL)
def _full(t: Tables) -> DataFrame:
    """Raw files through all three layers; the monthly gold table is read back."""
    paths = full_run(t.spark, raw_folder(t), run_folder(t.spark, "medallion"))
    return t.spark.read.parquet(paths["monthly_sales"]).withColumn("total_sales", F.round("total_sales", 4))


@BOOK.add(
    "x06_streamed_silver",
    """SELECT CAST(o_orderkey AS VARCHAR) AS transactionid, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, o_totalprice AS totalrevenue,
              CAST(o_custkey % 9 AS INTEGER) AS unitssold, o_orderpriority AS location FROM orders WHERE o_orderstatus <> 'P'""",
)
def _streamed(t: Tables) -> DataFrame:
    base = run_folder(t.spark, "stream")
    ingest_files(t.spark, raw_folder(t), raw_sales(t).columns, base)
    return read_silver(t.spark, base).select("transactionid", "date", "price", "totalrevenue", "unitssold", "location")


# Shares of the events that the streams read, one per trigger.
STREAM_SHARES = 4


def event_stream(t: Tables, in_order: bool) -> DataFrame:
    """The events in shares, one per trigger: by time, or dealt out without regard to it. A share is as many files as there are cores."""
    folder = run_folder(t.spark, "event-files")
    events, files = t.events, t.spark.sparkContext.defaultParallelism
    if in_order:
        shares = [n / STREAM_SHARES for n in range(1, STREAM_SHARES)]
        cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), shares, 10_000)).first()[0]
        share = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.unix_micros(F.col("ts").cast("timestamp"))))
    else:
        share = F.pmod(F.xxhash64("event_id"), F.lit(STREAM_SHARES))
    for number in range(STREAM_SHARES):
        # Streams read files by the time they were written.
        events.filter(share == number).repartition(files).write.parquet(f"{folder}/{number}")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return stream.parquet(folder)


@BOOK.add("x01_unique_stream", "SELECT event_id, user_id, event_type FROM events")
def _unique_stream(t: Tables) -> DataFrame:
    """Every event twice in the stream, in any order of time; one copy comes out."""
    path = run_folder(t.spark, "unique-events")
    doubled = event_stream(t, False).select("event_id", "ts", "user_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    query = unique_stream(doubled).writeStream.option("checkpointLocation", f"{path}-checkpoint")
    query.format("parquet").trigger(availableNow=True).start(path).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type")


@BOOK.add("x01_unique_store", "SELECT event_id, user_id, event_type FROM events")
def _unique_store(t: Tables) -> DataFrame:
    """The same with a store of ids in place of a growing state: all events twice, the copies trigger by trigger after the rest."""
    path = run_folder(t.spark, "unique-store")
    events, files = t.events.select("event_id", "ts", "user_id", "event_type"), t.spark.sparkContext.defaultParallelism
    for number in range(STREAM_SHARES):
        # In a share: its own events, and copies of the events of all shares before.
        own = F.pmod(F.xxhash64("event_id"), F.lit(STREAM_SHARES))
        events.filter(own <= number).repartition(files).write.parquet(f"{path}-files/{number}")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    unique.write_unique(stream.parquet(f"{path}-files"), path, f"{path}-checkpoint")
    return unique.unique_events(t.spark, path).select("event_id", "user_id", "event_type")


@BOOK.add("x02_state_stream", _STATES + " SELECT * FROM states")
def _state_stream(t: Tables) -> DataFrame:
    """The state machine as a stream ends in the same states as in batch."""
    path = run_folder(t.spark, "states")
    write_states(state_stream(activity_events(event_stream(t, True))), path, f"{path}-checkpoint")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at", "updated_at")}
    return latest_states(t.spark, path).withColumns(times)


@BOOK.add("x04_retained_stream", _CLOSED + " SELECT * FROM x ORDER BY started_at DESC, execution_id DESC LIMIT 100")
def _retained_stream(t: Tables) -> DataFrame:
    """The last hundred executions, kept from trigger to trigger."""
    path = run_folder(t.spark, "retained")
    write_retained(execution_stream(activity_events(event_stream(t, True))), path, f"{path}-checkpoint")
    return kept_executions(t.spark, path)
