"""Daily series of order totals, overall and per order priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.operators import series as op

BOOK = Book()

# One series per order priority.
DAYS = """days AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y
                   FROM orders GROUP BY 1, 2)"""
DENSE = DAYS + """,
  span AS (SELECT series_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY))::DATE AS ds FROM days GROUP BY 1),
  cal AS (SELECT span.series_id, span.ds, y FROM span LEFT JOIN days ON span.series_id = days.series_id AND span.ds = days.ds),
  near AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN ds END) OVER (PARTITION BY series_id ORDER BY ds) AS d0,
             min(CASE WHEN y IS NOT NULL THEN ds END) OVER (PARTITION BY series_id ORDER BY ds DESC) AS d1 FROM cal),
  dense AS (SELECT n.series_id, n.ds, CASE WHEN n.y IS NOT NULL THEN n.y
              ELSE a.y + (b.y - a.y) * date_diff('day', d0, n.ds) / CAST(date_diff('day', d0, d1) AS DOUBLE) END AS y, n.y IS NULL AS filled
            FROM near n JOIN days a ON a.series_id = n.series_id AND a.ds = n.d0
                        JOIN days b ON b.series_id = n.series_id AND b.ds = n.d1),
  idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS time_index FROM dense)"""


def by_priority(t: Tables) -> DataFrame:
    return op.daily_series(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority")


def dense(t: Tables) -> DataFrame:
    return op.prepare(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@BOOK.add(
    "d02_repeated_dates",
    """SELECT count(*) AS row_count, count(DISTINCT CAST(o_orderdate AS DATE)) AS distinct_dates,
              count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) AS duplicate_dates FROM orders""",
)
def _repeated(t: Tables) -> DataFrame:
    return op.repeated_dates(t.orders, "o_orderdate", "o_totalprice")


@BOOK.add("d02_summed_dates", f"WITH {DAYS} SELECT series_id, ds, round(y, 4) AS y FROM days")
def _summed(t: Tables) -> DataFrame:
    return rounded(by_priority(t), "y")


@BOOK.add("j08_filled_calendar", f"WITH {DENSE} SELECT series_id, ds, round(y, 4) AS y FROM cal")
def _calendar(t: Tables) -> DataFrame:
    return rounded(op.fill_calendar(by_priority(t)), "y")


@BOOK.add("w04_interpolated", f"WITH {DENSE} SELECT series_id, ds, round(y, 4) AS y, filled FROM dense")
def _interpolated(t: Tables) -> DataFrame:
    return rounded(op.interpolate(by_priority(t)), "y")


@BOOK.add("e01_prepared_series", f"WITH {DENSE} SELECT series_id, ds, round(y, 4) AS y FROM dense")
def _prepared(t: Tables) -> DataFrame:
    return rounded(dense(t), "y")


@BOOK.add(
    "a11_weekday_means",
    f"WITH {DENSE} SELECT series_id, dayname(ds) AS day_of_week, round(avg(y), 4) AS mean_value FROM dense GROUP BY 1, 2",
)
def _weekdays(t: Tables) -> DataFrame:
    return rounded(op.weekday_means(dense(t)), "mean_value")


@BOOK.add(
    "a11_month_means",
    f"WITH {DENSE} SELECT series_id, strftime(ds, '%Y-%m') AS month, round(avg(y), 4) AS mean_value FROM dense GROUP BY 1, 2",
)
def _months(t: Tables) -> DataFrame:
    return rounded(op.month_means(dense(t)), "mean_value")


_QUARTILES = """quart AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM dense GROUP BY 1),
  outs AS (SELECT series_id, q1, q3, count(*) FILTER (q3 > q1 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))) AS outlier_count
           FROM dense JOIN quart USING (series_id) GROUP BY 1, 2, 3)"""
_TREND = """slopes AS (SELECT series_id, count(*) AS periods, regr_slope(y, time_index) AS slope FROM idx GROUP BY 1)"""
_DIRECTION = "CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction"


@BOOK.add(
    "a12_outliers",
    f"WITH {DENSE}, {_QUARTILES} SELECT series_id, round(q1, 4) AS q1, round(q3, 4) AS q3, outlier_count FROM outs",
)
def _outliers(t: Tables) -> DataFrame:
    return rounded(op.outliers(dense(t)), "q1", "q3")


@BOOK.add(
    "a13_trend",
    f"WITH {DENSE}, {_TREND} SELECT series_id, periods, round(slope, 4) AS slope, {_DIRECTION} FROM slopes",
)
def _trend(t: Tables) -> DataFrame:
    return rounded(op.trend(dense(t)), "slope")


@BOOK.add(
    "e02_described_series",
    f"""WITH {DENSE}, {_QUARTILES}, {_TREND},
        wd AS (SELECT series_id, dayname(ds) AS k, avg(y) AS v FROM dense GROUP BY 1, 2),
        mo AS (SELECT series_id, strftime(ds, '%Y-%m') AS k, avg(y) AS v FROM dense GROUP BY 1, 2)
        SELECT series_id, periods, round(slope, 4) AS slope, {_DIRECTION}, outlier_count,
          (SELECT round(v, 4) FROM wd WHERE wd.series_id = s.series_id AND k = 'Monday') AS monday_mean,
          (SELECT round(v, 4) FROM mo WHERE mo.series_id = s.series_id AND k = '1997-03') AS march_mean,
          (SELECT count(*) FROM mo WHERE mo.series_id = s.series_id) AS months, periods >= 14 AS weekly_enabled
        FROM slopes s JOIN outs USING (series_id)""",
)
def _described(t: Tables) -> DataFrame:
    found = op.describe(dense(t))
    return found.select(
        "series_id",
        "periods",
        F.round("slope", 4).alias("slope"),
        "direction",
        "outlier_count",
        F.round(F.col("weekday_mean")["Monday"], 4).alias("monday_mean"),
        F.round(F.col("monthly_mean")["1997-03"], 4).alias("march_mean"),
        F.size("monthly_mean").cast("bigint").alias("months"),
        "weekly_enabled",
    )


_WINDOWS = """lagged AS (SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7,
    count(y) OVER p AS n7, avg(y) OVER p AS m7, stddev_samp(y) OVER p AS s7 FROM idx
    WINDOW w AS (PARTITION BY series_id ORDER BY ds),
           p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""


@BOOK.add(
    "w01_lags",
    f"WITH {DENSE}, {_WINDOWS} SELECT series_id, ds, round(y, 4) AS y, round(lag_1, 4) AS lag_1, round(lag_7, 4) AS lag_7 FROM lagged",
)
def _lags(t: Tables) -> DataFrame:
    return rounded(op.lags(dense(t)), "y", "lag_1", "lag_7")


@BOOK.add(
    "w02_trailing_week",
    f"""WITH {DENSE}, {_WINDOWS} SELECT series_id, ds, round(y, 4) AS y, round(CASE WHEN n7 = 7 THEN m7 END, 3) AS rolling_mean_7,
        round(CASE WHEN n7 = 7 THEN s7 ELSE 0 END, 3) AS rolling_std_7 FROM lagged""",
)
def _trailing(t: Tables) -> DataFrame:
    out = rounded(op.trailing_week(dense(t)), "y")
    return rounded(out, "rolling_mean_7", "rolling_std_7", digits=3)


_FEATURES = f"""WITH {DENSE}, {_WINDOWS} SELECT series_id, ds, round(y, 4) AS y, round(lag_1, 4) AS lag_1, round(lag_7, 4) AS lag_7,
    round(m7, 3) AS rolling_mean_7, round(s7, 3) AS rolling_std_7, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week,
    CAST(month(ds) AS INTEGER) AS month, CAST(time_index AS INTEGER) AS time_index FROM lagged WHERE lag_7 IS NOT NULL AND n7 = 7"""


@BOOK.add("e03_feature_matrix", _FEATURES)
def _matrix(t: Tables) -> DataFrame:
    out = rounded(op.feature_matrix(dense(t)), "y", "lag_1", "lag_7")
    return rounded(out, "rolling_mean_7", "rolling_std_7", digits=3)


@BOOK.add(
    "w03_calendar_features",
    f"""WITH {DENSE} SELECT series_id, ds, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(month(ds) AS INTEGER) AS month,
        CAST(time_index AS INTEGER) AS time_index FROM idx WHERE time_index >= 7""",
)
def _calendar_features(t: Tables) -> DataFrame:
    return op.feature_matrix(dense(t)).select("series_id", "ds", "day_of_week", "month", "time_index")


@BOOK.add(
    "w05_last_rows",
    f"""WITH {DAYS} SELECT series_id, ds, round(y, 4) AS y FROM days
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 7""",
)
def _last(t: Tables) -> DataFrame:
    return rounded(op.last_rows(by_priority(t)), "y")


@BOOK.add(
    "w06_train_validation_split",
    f"""WITH {DENSE} SELECT series_id, ds, CASE WHEN time_index >= n - greatest(14, CAST(floor(n * 0.2) AS INTEGER)) THEN 'validation' ELSE 'train' END AS part
        FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM idx)""",
)
def _split(t: Tables) -> DataFrame:
    return op.split(dense(t)).select("series_id", "ds", "part")
