"""Gold aggregates of a sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.operators.cleaning import with_calendar

PRODUCT_COLUMNS = ("mobilemodel", "mobile_model")
REVENUE = "totalrevenue"
UNITS = "unitssold"


def sales_measures(df: DataFrame) -> list[Column]:
    """Totals that the table can deliver: units only where there is a unit column."""
    measures = [F.sum(REVENUE).alias("total_sales")]
    if UNITS in df.columns:
        measures.append(F.sum(UNITS).cast("bigint").alias("total_quantity"))
    return measures


def sales_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*sales_measures(df))


def product_column(df: DataFrame) -> str | None:
    return next((c for c in PRODUCT_COLUMNS if c in df.columns), None)


def sales_by_product(df: DataFrame) -> DataFrame:
    key = product_column(df)
    if key is None:
        raise ValueError("no product column")
    return sales_by(df, key).orderBy(F.desc("total_sales"), key)


def sales_by_location(df: DataFrame) -> DataFrame:
    return sales_by(df, "location").orderBy(F.desc("total_sales"), "location")


def daily_sales(df: DataFrame) -> DataFrame:
    """Totals per day; calendar columns are derived after the shuffle, from one row per day."""
    return with_calendar(sales_by(df, "date")).select("date", "year", "month", *_totals(df))


def monthly_sales(df: DataFrame) -> DataFrame:
    return sales_by(with_calendar(df), "year", "month")


def time_analysis(df: DataFrame) -> DataFrame:
    """Row-grain calendar view of the sales."""
    units = [F.col(UNITS)] if UNITS in df.columns else []
    return with_calendar(df).select("date", "year", "month", REVENUE, *units)


def sales_summary(df: DataFrame) -> DataFrame:
    measures = sales_measures(df)
    return df.agg(measures[0], F.avg(REVENUE).alias("average_sales"), *measures[1:])


def _totals(df: DataFrame) -> list[str]:
    return ["total_sales"] + (["total_quantity"] if UNITS in df.columns else [])


def gold_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All gold outputs whose key columns are present, by output name."""
    out = {"base": df, "summary": sales_summary(df)}
    if product_column(df):
        out["sales_by_product"] = sales_by_product(df)
    if "location" in df.columns:
        out["sales_by_location"] = sales_by_location(df)
    if "date" in df.columns:
        out["daily_sales"] = daily_sales(df)
        out["monthly_sales"] = monthly_sales(df)
    return out


def _axes(df: DataFrame) -> list[str]:
    """Columns that gold tables are keyed by, where present: product, location, date."""
    return [c for c in (product_column(df), "location", "date") if c and c in df.columns]


def gold_cube(df: DataFrame) -> DataFrame:
    """Totals per product, per location, per day and over all, from one scan; ``grouping`` tells which.

    Every task adds up all of them before anything is shuffled.
    """
    axes = _axes(df)
    measures = [*sales_measures(df), F.count(REVENUE).alias("_counted")]
    sets = [[c] for c in axes] + [[]]
    grouped = df.groupingSets(sets, *axes) if axes else df.groupBy()
    grouping = F.grouping_id() if axes else F.lit(0)
    return grouped.agg(grouping.cast("int").alias("grouping"), *measures)


def gold_from_cube(df: DataFrame, cube: DataFrame) -> dict[str, DataFrame]:
    """The outputs of :func:`gold_tables`, all but the base from a stored :func:`gold_cube` of the table."""
    axes = _axes(df)
    whole = (1 << len(axes)) - 1
    totals = _totals(df)

    def of(axis: str) -> DataFrame:
        return cube.filter(F.col("grouping") == whole - (1 << (len(axes) - 1 - axes.index(axis)))).select(axis, *totals)

    average = F.try_divide(F.col("total_sales"), F.col("_counted")).alias("average_sales")
    out = {"base": df, "summary": cube.filter(F.col("grouping") == whole).select("total_sales", average, *totals[1:])}
    product = product_column(df)
    if product:
        out["sales_by_product"] = of(product).orderBy(F.desc("total_sales"), product)
    if "location" in axes:
        out["sales_by_location"] = of("location").orderBy(F.desc("total_sales"), "location")
    if "date" in axes:
        days = with_calendar(of("date"))
        out["daily_sales"] = days.select("date", "year", "month", *totals)
        out["monthly_sales"] = days.groupBy("year", "month").agg(*[F.sum(c).alias(c) for c in totals])
    return out
