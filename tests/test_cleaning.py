import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from saltmarsh.functions.numbers import coerce_double, coerce_int, numeric_text, parse_date
from saltmarsh.operators import cleaning as cl, quality as ql
from saltmarsh.operators.rows import distinct_rows
from saltmarsh.plans.medallion import silver_frame


@pytest.mark.parametrize(
    "text,number",
    [
        ("60s", 60.0), ("1,200.50", 1200.5), (" 12.5kg ", 12.5), ("N/A", None), ("na", None), ("Unknown", None), ("", None),
        (None, None), ("INF", None), ("-INF", None), ("NAN", None), ("1 000", 1000.0), ("-3", -3.0), ("abc", None), ("7", 7.0),
    ],
)
def test_numeric_text(spark, text, number):
    frame = spark.createDataFrame([(text,)], "v string")
    assert frame.select(numeric_text(F.col("v")).try_cast("double")).first()[0] == number


def test_names_and_aliases(spark):
    frame = spark.createDataFrame([(1, 2, "x")], "` Transaction ID ` int, QTY int, `Customer Gender` string")
    folded = cl.fold_aliases(cl.normalise_names(frame))
    assert folded.columns == ["transaction_id", "unitssold", "customergender"]
    with pytest.raises(ValueError, match="not distinct"):
        cl.normalise_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_canonical_alias_wins(spark):
    frame = spark.createDataFrame([(1, 2)], "qty int, unitssold int")
    assert cl.fold_aliases(frame).columns == ["qty", "unitssold"]


def test_dates(spark):
    rows = [("2024-02-29",), ("2024-02-29 10:11:12",), ("2024-02-30",), ("29/02/2024",), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "d string").select(parse_date(F.col("d"))).collect()]
    assert found == [dt.date(2024, 2, 29), dt.date(2024, 2, 29), None, None, None]


def test_text_columns(spark):
    rows = [(" a\t\n\tb ", 1), ("NULL", 2), ("null", 3), ("  ", 4), ("Null", 5), (None, 6)]
    found = [r[0] for r in cl.clean_text_columns(spark.createDataFrame(rows, "t string, n int")).orderBy("n").collect()]
    assert found == ["a b", None, None, None, "Null", None]


def test_text_without_line_ends_meets_no_pattern(spark):
    rows = [(t,) for t in ("a\r\n\r\nb", "\t", " \n ", " NULL ", "NULL\n", "nullx", "a  b", "", " x\ty\tz ")]
    frame = spark.createDataFrame(rows, "t string")
    cleaned = cl.clean_text_columns(frame)
    assert [r.t for r in cleaned.collect()] == ["a b", " ", " ", None, "NULL ", "nullx", "a  b", None, "x y z"]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    # Nulls are found by comparison, and runs are replaced only in text that contains one of the characters.
    assert "regexp_extract_all" not in plan and plan.index("Contains(") < plan.index("regexp_replace")


def test_dates_need_no_format(spark):
    texts = ["0001-01-01", "9999-12-31", "2023-02-29", "2024-13-01", "2024-02-29 24:00:00", "2024-02-29 23:59:59 ", "2024-1-1", "", "2024-01-01\n", "02024-01-01", "2024"]
    found = spark.createDataFrame([(t,) for t in texts], "d string").select(parse_date(F.col("d")).alias("d"))
    assert [r.d for r in found.collect()] == [dt.date(1, 1, 1), dt.date(9999, 12, 31)] + [None] * 9
    assert "timestamp" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_silver_chain(spark):
    rows = [
        ("t1", "2024-01-01", "1,200", "10", "2", " NULL ", "a.csv", 1),
        ("t1", "2024-01-01", "1,200", "10", "2", None, "b.csv", 2),
        ("t2", "bad", "5", "5", "1", "F", "a.csv", 1),
        ("t3", "2024-01-02 03:04:05", "7", "7.5", "3", "M", "a.csv", 1),
        (None, "2024-01-02", "7", "7.5", "3", "M", "a.csv", 1),
    ]
    schema = "TransactionID string, Date string, Price string, TotalRevenue string, `Units Sold` string, CustomerGender string, source_file string, ingestion_timestamp int"
    raw = cl.sanitise_numbers(spark.createDataFrame(rows, schema), {"price": "double"})
    silver = silver_frame(raw).orderBy("transactionid").collect()
    assert [(r.transactionid, r.date, r.price, r.unitssold, r.customergender, r.source_file) for r in silver] == [
        ("t1", dt.date(2024, 1, 1), 1200.0, 2, "Unknown", "a.csv"),
        ("t3", dt.date(2024, 1, 2), 7.0, 3, "M", "a.csv"),
    ]


def test_missing_required_column(spark):
    with pytest.raises(ValueError, match="absent"):
        cl.require_columns(spark.createDataFrame([(1,)], "date int"), ["date", "price"])


def test_distinct_is_idempotent(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "x int, y string")
    once = distinct_rows(frame)
    assert sorted(map(str, once.collect())) == sorted(map(str, distinct_rows(once).collect()))
    assert once.count() == 2


def test_coercion_threshold(spark):
    rows = [("1", "2024-01-01", "x"), ("2", "bad", "1"), ("3", None, "2"), ("4", "2024-01-02", "3"), ("oops", "2024-01-03", "y")]
    out = cl.coerce_by_content(spark.createDataFrame(rows, "n string, some_date string, m string"))
    assert dict(out.dtypes) == {"n": "double", "some_date": "timestamp_ntz", "m": "string"}
    assert [r.n for r in out.collect()] == [1.0, 2.0, 3.0, 4.0, None]


def test_integers_and_doubles(spark):
    rows = [(" 3 ",), ("3.7",), ("x",), (None,)]
    frame = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in frame.select(coerce_int(F.col("v"))).collect()] == [3, 0, 0, 0]
    assert [r[0] for r in frame.select(coerce_double(F.col("v"))).collect()] == [3.0, 3.7, 0.0, 0.0]


def test_quality(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b")], "x int, y string")
    assert ql.quality_score(frame).first() == Row(
        row_count=3, column_count=2, missing_values=1, missing_percentage=16.67, duplicates_removed=1, quality_score=83.33
    )
    empty = frame.limit(0)
    assert ql.quality_score(empty).first()["quality_score"] == 100.0
    assert ql.duplicate_count(empty).first() == Row(total_rows=0, distinct_rows=0, duplicate_rows=0)


def test_roles(spark):
    rows = [(f"{i}", f"2024-01-{i:02d}", float(i * i), i % 3, 1000 + i) for i in range(1, 21)]
    frame = spark.createDataFrame(rows, "order_id string, day_date string, sales_amount double, width int, zip_code int")
    roles = {(r["column_name"], r["role"]): r["score"] for r in ql.column_roles(frame)}
    assert ("day_date", "date") in roles and ("zip_code", "identifier") in roles
    assert ("width", "identifier") not in roles
    assert roles["sales_amount", "target"] == 18
    assert ql.choose_series_columns(frame) == ("day_date", "sales_amount")
