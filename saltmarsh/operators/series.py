"""Daily series: preparation, description, features and splits.

A series frame has the columns ``series_id, ds, y`` with one row per day, so a
window over one series never holds more rows than the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def _ordered():
    return W.partitionBy("series_id").orderBy("ds")


def _whole():
    return W.partitionBy("series_id")


MIN_PERIODS = 30


def daily_series(df: DataFrame, date: str, value: str, series: str | None = None) -> DataFrame:
    """Sum per day and series; rows without a usable date or value are dropped."""
    key = F.lit("all") if series is None else F.col(series)
    kind = df.schema[date].dataType.simpleString()
    day = F.to_date(date) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(date).try_cast("date")
    rows = df.select(key.alias("series_id"), day.alias("ds"), F.col(value).try_cast("double").alias("y"))
    return rows.dropna(subset=["ds", "y"]).groupBy("series_id", "ds").agg(F.sum("y").alias("y"))


def repeated_dates(df: DataFrame, date: str, value: str) -> DataFrame:
    """Rows, distinct days and surplus rows of a table with several rows per day."""
    days = (
        df.select(F.to_date(date).alias("ds"), F.col(value).alias("y"))
        .dropna(subset=["ds", "y"])
        .groupBy("ds")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return days.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_dates"),
    ).withColumn("duplicate_dates", F.col("row_count") - F.col("distinct_dates"))


def fill_calendar(series: DataFrame) -> DataFrame:
    """Every day between first and last, with null where nothing was observed."""
    spans = series.groupBy("series_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = spans.select("series_id", F.explode(F.sequence("lo", "hi")).alias("ds"))
    return days.join(series, ["series_id", "ds"], "left")


def interpolate(series: DataFrame) -> DataFrame:
    """Dense daily series, gaps filled on the straight line between their neighbours.

    Each observed day spawns the missing days up to its successor, so neither a
    calendar table nor a join is needed.
    """
    ahead = series.select(
        "series_id", "ds", "y", F.lead("ds").over(_ordered()).alias("next_ds"), F.lead("y").over(_ordered()).alias("next_y")
    )
    span = F.coalesce(F.date_diff("next_ds", "ds"), F.lit(1))
    steps = ahead.withColumn("span", span).select("*", F.explode(F.sequence(F.lit(0), span - 1)).alias("step"))
    value = F.when(F.col("step") == 0, F.col("y")).otherwise(
        F.col("y") + (F.col("next_y") - F.col("y")) * F.col("step") / F.col("span")
    )
    return steps.select(
        "series_id", F.date_add("ds", F.col("step")).alias("ds"), value.alias("y"), (F.col("step") > 0).alias("filled")
    )


def prepare(df: DataFrame, date: str, value: str, series: str | None = None, min_periods: int = MIN_PERIODS, short: str = "error") -> DataFrame:
    """Dense daily series ready for features; short series are an error or are skipped."""
    dense = interpolate(daily_series(df, date, value, series)).select("series_id", "ds", "y")
    counted = dense.withColumn("periods", F.count(F.lit(1)).over(_whole()))
    if short == "skip":
        return counted.filter(F.col("periods") >= min_periods).drop("periods")
    message = F.concat(
        F.lit(f"at least {min_periods} usable periods are required; series "),
        F.col("series_id"), F.lit(" has "), F.col("periods").cast("string"),
    )
    checked = F.when(F.col("periods") < min_periods, F.raise_error(message).cast("double")).otherwise(F.col("y"))
    return counted.select("series_id", "ds", checked.alias("y"))


def indexed(series: DataFrame) -> DataFrame:
    return series.withColumn("time_index", F.row_number().over(_ordered()) - 1)


def weekday_means(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", F.date_format("ds", "EEEE").alias("day_of_week")).agg(
        F.avg("y").alias("mean_value")
    )


def month_means(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", F.date_format("ds", "yyyy-MM").alias("month")).agg(
        F.avg("y").alias("mean_value")
    )


def outliers(series: DataFrame) -> DataFrame:
    """Quartiles and the number of days outside 1.5 interquartile ranges."""
    quartiles = series.groupBy("series_id").agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    # One row per series on the small side; the optimizer decides whether that is small enough to broadcast.
    marked = series.join(quartiles.select("series_id", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")), "series_id")
    spread = F.col("q3") - F.col("q1")
    outside = (spread > 0) & (
        (F.col("y") < F.col("q1") - 1.5 * spread) | (F.col("y") > F.col("q3") + 1.5 * spread)
    )
    return marked.groupBy("series_id").agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.count_if(outside).alias("outlier_count")
    )


def trend(series: DataFrame) -> DataFrame:
    slope = F.coalesce(F.regr_slope("y", "time_index"), F.lit(0.0))
    return indexed(series).groupBy("series_id").agg(slope.alias("slope"), F.count(F.lit(1)).alias("periods")).select(
        "series_id",
        "periods",
        "slope",
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat").alias("direction"),
    )


def describe(series: DataFrame) -> DataFrame:
    """One row per series: trend, outliers, weekday and month means, weekly flag."""
    weekday = weekday_means(series).groupBy("series_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("day_of_week", "mean_value")))).alias("weekday_mean")
    )
    monthly = month_means(series).groupBy("series_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "mean_value")))).alias("monthly_mean")
    )
    return (
        trend(series)
        .join(outliers(series), "series_id")
        .join(weekday, "series_id")
        .join(monthly, "series_id")
        .withColumn("weekly_enabled", F.col("periods") >= 14)
    )


def lags(series: DataFrame) -> DataFrame:
    return series.withColumns(
        {"lag_1": F.lag("y", 1).over(_ordered()), "lag_7": F.lag("y", 7).over(_ordered())}
    )


def trailing_week(series: DataFrame) -> DataFrame:
    """Mean and sample deviation of the seven rows before the current one."""
    past = _ordered().rowsBetween(-7, -1)
    return series.withColumns(
        {
            "rolling_mean_7": F.when(F.count("y").over(past) == 7, F.avg("y").over(past)),
            "rolling_std_7": F.when(F.count("y").over(past) == 7, F.stddev_samp("y").over(past)).otherwise(0.0),
        }
    )


def feature_matrix(series: DataFrame) -> DataFrame:
    """Lag features per day; the first seven days, which lack some, are left out."""
    full = indexed(trailing_week(lags(series))).withColumns(
        {"day_of_week": F.weekday("ds"), "month": F.month("ds")}
    )
    return full.dropna()


def last_rows(series: DataFrame, n: int = 7) -> DataFrame:
    """The latest n rows per series; ranks are cut on the map side before the shuffle."""
    newest = W.partitionBy("series_id").orderBy(F.desc("ds"), F.desc("y"))
    return series.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def split(series: DataFrame, share: float = 0.2, at_least: int = 14) -> DataFrame:
    """Mark the last rows of each series as validation."""
    size = F.greatest(F.lit(at_least), F.floor(F.count(F.lit(1)).over(_whole()) * F.lit(share)).cast("int"))
    start = F.count(F.lit(1)).over(_whole()) - size
    return indexed(series).withColumn("part", F.when(F.col("time_index") >= start, "validation").otherwise("train"))


def split_daily(series: DataFrame, share: float = 0.2, at_least: int = 14) -> DataFrame:
    """As :func:`split`, for series with a row for every day: places follow from dates, and no series is sorted in one task."""
    spans = series.groupBy("series_id").agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"), F.count(F.lit(1)).alias("_n"))
    gap = F.raise_error(F.concat(F.lit("days are missing in series "), F.col("series_id").cast("string"))).cast("int")
    first = F.when(F.date_diff("_last", "_first") + 1 == F.col("_n"), F.col("_first")).otherwise(F.date_add("_first", gap))
    rows = series.join(spans.withColumn("_first", first), "series_id").withColumn("time_index", F.date_diff("ds", "_first"))
    start = F.col("_n") - F.greatest(F.lit(at_least), F.floor(F.col("_n") * F.lit(share)).cast("int"))
    return rows.withColumn("part", F.when(F.col("time_index") >= start, "validation").otherwise("train")).drop("_first", "_last", "_n")
