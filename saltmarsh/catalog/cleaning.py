"""Bronze-to-silver cleaning over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.operators import cleaning as op
from saltmarsh.operators.rows import distinct_rows
from saltmarsh.plans.medallion import bronze_to_silver, silver_report
from saltmarsh.scratch import run_folder
from saltmarsh.sources.sinks import write_table

BOOK = Book()


@BOOK.add(
    "p01_normalised_names",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd, o_orderstatus AS status_2 FROM orders",
)
def _names(t: Tables) -> DataFrame:
    raw = t.orders.select(
        F.col("o_orderkey").alias(" Order Key "),
        F.col("o_totalprice").alias("Total--Price (USD)"),
        F.col("o_orderstatus").alias("_Status 2_"),
    )
    return op.normalise_names(raw)


@BOOK.add(
    "p02_folded_aliases",
    "SELECT l_orderkey, l_linenumber, l_quantity AS unitssold, l_tax AS units_sold FROM lineitem",
)
def _aliases(t: Tables) -> DataFrame:
    named = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("unitsold"), F.col("l_tax").alias("units_sold"))
    return op.fold_aliases(named)


_NOISY = """CASE CAST(l_linenumber AS INTEGER)
  WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 's'
  WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',000.50 '
  WHEN 3 THEN CASE l_returnflag WHEN 'A' THEN 'n/a' WHEN 'N' THEN 'Unknown' ELSE '' END
  WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.25 kg'
  WHEN 5 THEN 'INF'
  ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"""


@BOOK.add(
    "p03_sanitised_numbers",
    f"""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim({_NOISY}) AS v FROM lineitem),
        b AS (SELECT *, regexp_replace(replace(replace(v, ',', ''), ' ', ''), '([0-9]+(\\.[0-9]+)?)[a-zA-Z]+$', '\\1') AS c FROM n)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN upper(v) IN ('NULL', 'N/A', 'NA', 'NONE', 'UNKNOWN') OR c IN ('', 'NAN', 'INF', '-INF')
                    THEN NULL ELSE TRY_CAST(c AS DOUBLE) END AS price
        FROM b""",
)
def _numbers(t: Tables) -> DataFrame:
    units = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    noisy = (
        F.when(line == 1, F.concat(units, F.lit("s")))
        .when(line == 2, F.concat(F.lit(" "), units, F.lit(",000.50 ")))
        .when(line == 3, F.when(F.col("l_returnflag") == "A", "n/a").when(F.col("l_returnflag") == "N", "Unknown").otherwise(""))
        .when(line == 4, F.concat(units, F.lit(".25 kg")))
        .when(line == 5, "INF")
        .otherwise(units)
    )
    raw = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", noisy.alias("price"))
    return op.sanitise_numbers(raw, {"Price": "double"})


@BOOK.add(
    "p04_cleaned_text",
    r"""SELECT doc_id, CASE WHEN trim(x) IN ('', 'NULL', 'null') THEN NULL
               ELSE regexp_replace(trim(x), '[\t\n\r]+', ' ', 'g') END AS text,
               CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang
        FROM (SELECT doc_id, lang, CASE source WHEN 'src1' THEN '  ' WHEN 'src2' THEN ' NULL' ELSE text || chr(9) || '  ' END AS x FROM documents)""",
)
def _text(t: Tables) -> DataFrame:
    text = F.when(F.col("source") == "src1", "  ").when(F.col("source") == "src2", " NULL").otherwise(F.concat("text", F.lit("\t  ")))
    lang = F.when(F.col("lang") == "fr", "null").otherwise(F.col("lang"))
    return op.clean_text_columns(t.documents.select("doc_id", text.alias("text"), lang.alias("lang")))


@BOOK.add(
    "p05_typed_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, CAST(trunc(l_quantity) AS INTEGER) AS unitssold,
              CAST(NULL AS DOUBLE) AS totalrevenue FROM lineitem""",
)
def _types(t: Tables) -> DataFrame:
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("l_quantity").alias("unitssold"),
        F.col("l_returnflag").alias("totalrevenue"),
    )
    return op.cast_numbers(raw)


@BOOK.add(
    "p06_normalised_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""",
)
def _dates(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    return op.normalise_date(t.orders.select("o_orderkey", text.alias("date")))


@BOOK.add(
    "p07_filled_missing",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Unknown' ELSE c_mktsegment END AS customergender FROM customer""",
)
def _fill(t: Tables) -> DataFrame:
    gender = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return op.fill_missing(t.customer.select("c_custkey", gender.alias("customergender")), {"customergender": "Unknown"})


@BOOK.add("p08_lineage", "SELECT o_orderkey, 'orders.parquet' AS source_file, true AS stamped FROM orders")
def _lineage(t: Tables) -> DataFrame:
    tagged = op.with_lineage(t.orders)
    return tagged.select("o_orderkey", "source_file", F.col("ingestion_timestamp").isNotNull().alias("stamped"))


@BOOK.add(
    "p11_coerced_types",
    """SELECT event_id, ts AS event_time, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE value END AS value,
              event_type AS kind, CASE WHEN event_type <> 'error' AND event_id % 20 <> 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS mixed
       FROM events""",
)
def _coerce(t: Tables) -> DataFrame:
    # Nine of ten values are numbers, but only three of four of the mixed ones.
    error, number = F.col("event_type") == "error", F.col("event_id")
    share = F.when(~(error & (number % 2 == 0)), F.col("value").cast("string")).otherwise("n/a")
    mixed = F.when(~error & (number % 20 != 0), F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    raw = t.events.select(
        "event_id",
        F.col("ts").cast("string").alias("event_time"),
        share.alias("value"),
        F.col("event_type").alias("kind"),
        mixed.alias("mixed"),
    )
    return op.coerce_by_content(raw)


def orders_with_gaps(t: Tables) -> DataFrame:
    """Orders in sales layout with missing values in every required column."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_orderkey").alias("transactionid"),
        F.when(~((status == "P") & (priority == "1-URGENT")), F.to_date("o_orderdate")).alias("date"),
        F.when(~((status == "F") & (priority == "5-LOW")), F.col("o_totalprice")).alias("price"),
        F.when(~((status == "O") & (priority == "2-HIGH")), F.col("o_totalprice")).alias("totalrevenue"),
    )


_GAPS = """(SELECT o_orderkey AS transactionid,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS totalrevenue
  FROM orders)"""
_COMPLETE = "date IS NOT NULL AND price IS NOT NULL AND totalrevenue IS NOT NULL"


@BOOK.add("f01_required_columns", f"SELECT * FROM {_GAPS} WHERE {_COMPLETE}")
def _required(t: Tables) -> DataFrame:
    return op.require_columns(orders_with_gaps(t))


@BOOK.add("f02_invalid_rows", f"SELECT * FROM {_GAPS} WHERE NOT ({_COMPLETE})")
def _invalid(t: Tables) -> DataFrame:
    return op.invalid_rows(orders_with_gaps(t))


@BOOK.add(
    "f02_validity_counts",
    f"""SELECT count(*) AS total_rows, count(*) FILTER ({_COMPLETE}) AS valid_rows,
               count(*) FILTER (NOT ({_COMPLETE})) AS invalid_rows FROM {_GAPS}""",
)
def _validity(t: Tables) -> DataFrame:
    return op.validity_counts(orders_with_gaps(t))


@BOOK.add(
    "f03_usable_series_rows",
    "SELECT event_id, ts AS date, value FROM events WHERE event_type <> 'error' AND value IS NOT NULL",
)
def _usable(t: Tables) -> DataFrame:
    date = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", date.alias("date"), "value").dropna(subset=["date", "value"])


@BOOK.add("d01_distinct_documents", "SELECT DISTINCT text, lang FROM documents")
def _distinct(t: Tables) -> DataFrame:
    return distinct_rows(t.documents.select("text", "lang"))


@BOOK.add(
    "d01_distinct_without_lineage",
    "SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang",
)
def _distinct_lineage(t: Tables) -> DataFrame:
    return distinct_rows(t.documents.select("text", "lang", "doc_id"), ignore=["doc_id"])


@BOOK.add(
    "g02_silver_rows",
    """SELECT DISTINCT trim(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS transactionid, CAST(o_orderdate AS DATE) AS date,
              l_extendedprice AS price, CAST(l_quantity AS INTEGER) AS unitssold,
              round(l_extendedprice * (1 - l_discount), 4) AS totalrevenue,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'Unknown' ELSE o_orderpriority END AS customergender
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""",
)
def _silver(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{layers(t)[0]}/silver")


@BOOK.add(
    "g02_silver_report",
    """WITH b AS (SELECT o_orderstatus AS s, o_orderpriority AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
          k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS r FROM lineitem),
          o AS (SELECT count(*) AS n FROM k JOIN orders ON l_orderkey = o_orderkey), v AS (SELECT count(*) AS n FROM k JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
       SELECT 2 * count(*) AS input_rows, 2 * count(*) FILTER (s = 'P') AS invalid_rows, 2 * count(*) FILTER (s = 'P') AS null_date,
              2 * count(*) FILTER (p = '1-URGENT') AS null_customergender, 2 * count(*) - (SELECT n FROM o) AS duplicate_rows, (SELECT n FROM v) AS output_rows FROM b""",
)
def _silver_report(t: Tables) -> DataFrame:
    base, counted = layers(t)
    report = silver_report(t.spark.read.parquet(f"{base}/bronze"), t.spark.read.parquet(f"{base}/silver"), counted)
    return report.select("input_rows", "invalid_rows", "null_date", "null_customergender", "duplicate_rows", "output_rows")


def layers(t: Tables) -> tuple[str, dict[str, int]]:
    """Stored bronze text with odd headers and copies, through the whole cleaning chain; the folder of both layers and what was counted."""
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    joined = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    date = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    gender = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).otherwise(" NULL ")
    raw = joined.select(
        F.concat(F.lit(" "), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("TransactionID"),
        date.alias("Date"),
        F.col("l_extendedprice").cast("string").alias("Price"),
        F.col("l_quantity").cast("int").cast("string").alias("Units Sold"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("string").alias("Total Revenue "),
        gender.alias("Customer Gender"),
    )
    named = raw.withColumnRenamed("Total Revenue ", "TotalRevenue")
    base = run_folder(t.spark, "layers")
    write_table(named, f"{base}/bronze")
    # The copies come from the rows that are stored already, and not from a second join.
    write_table(t.spark.read.parquet(f"{base}/bronze"), f"{base}/bronze", mode="append")
    return base, bronze_to_silver(t.spark, f"{base}/bronze", f"{base}/silver")


