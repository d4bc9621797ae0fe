"""Forecasts of the daily order series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.timeseries import DAYS, DENSE, by_priority, dense, rounded
from saltmarsh.operators import forecast as op
from saltmarsh.operators.regression import lag_regression
from saltmarsh.operators.series import split, split_daily
from saltmarsh.plans.upload import run_upload

BOOK = Book()

# Last seven days; the last two are held out (7 / 3 rounded down).
SHORT = (
    DAYS
    + """,
  win AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos, max(ds) OVER (PARTITION BY series_id) AS last_ds
          FROM (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 7)),
  line AS (SELECT series_id, max(last_ds) AS last_ds, count(*) AS record_count, regr_slope(y, pos) FILTER (pos < 5) AS b,
           regr_intercept(y, pos) FILTER (pos < 5) AS a FROM win GROUP BY 1),
  err AS (SELECT win.series_id, y, y - (a + b * pos) AS gap FROM win JOIN line USING (series_id) WHERE pos >= 5),
  score AS (SELECT series_id, avg(abs(gap)) AS mae, sqrt(avg(gap * gap)) AS rmse,
            avg(abs(gap / y)) FILTER (y <> 0) * 100 AS mape, stddev_pop(gap) AS residual_std FROM err GROUP BY 1)"""
)


@BOOK.add(
    "e06_linear_trend",
    f"""WITH {SHORT} SELECT series_id, ds AS date, round(y, 4) AS actual, CAST(NULL AS DOUBLE) AS forecast,
               CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM win
        UNION ALL SELECT series_id, CAST(last_ds + CAST(k AS INTEGER) AS DATE), NULL, round(a + b * (record_count + k - 1), 4),
               round(a + b * (record_count + k - 1) - 1.96 * residual_std, 4), round(a + b * (record_count + k - 1) + 1.96 * residual_std, 4)
        FROM line JOIN score USING (series_id), generate_series(1, 14) g(k)""",
)
def _trend(t: Tables) -> DataFrame:
    return rounded(op.trend_forecast(by_priority(t)), "actual", "forecast", "lower_bound", "upper_bound")


@BOOK.add(
    "e07_prediction_interval",
    f"WITH {SHORT} SELECT series_id, round(1.96 * residual_std, 4) AS margin FROM score",
)
def _interval(t: Tables) -> DataFrame:
    models = op.trend_models(by_priority(t))
    return models.select("series_id", F.round(op.Z95 * F.col("residual_std"), 4).alias("margin"))


@BOOK.add(
    "a14_error_metrics",
    f"WITH {SHORT} SELECT series_id, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape FROM score",
)
def _errors(t: Tables) -> DataFrame:
    return op.trend_models(by_priority(t)).select("series_id", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@BOOK.add(
    "w06_short_holdout",
    f"WITH {SHORT} SELECT series_id, ds, CAST(pos AS INTEGER) AS pos, pos >= 5 AS held_out FROM win",
)
def _holdout(t: Tables) -> DataFrame:
    return op.short_window(by_priority(t)).select("series_id", "ds", "pos", "held_out")


@BOOK.add(
    "u05_actual_and_forecast",
    f"""WITH {SHORT} SELECT series_id, count(*) FILTER (k = 0) AS actual_rows, count(*) FILTER (k > 0) AS forecast_rows
        FROM (SELECT series_id, 0 AS k FROM win UNION ALL SELECT series_id, k FROM line, generate_series(1, 30) g(k)) GROUP BY 1""",
)
def _padded(t: Tables) -> DataFrame:
    rows = op.trend_forecast(by_priority(t), horizon=30)
    return rows.groupBy("series_id").agg(
        F.count("actual").alias("actual_rows"), F.count("forecast").alias("forecast_rows")
    )


# Both models are fitted on the training part (validation rows) and on all rows (future rows).
CUT = (
    DENSE
    + """,
  cut AS (SELECT *, n - greatest(14, CAST(floor(n * 0.2) AS INTEGER)) AS start FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM idx))"""
)
# The weekly model; the horizon is filled in.
WEEKLY = (
    CUT
    + """,
  fits AS (SELECT series_id, ds, y, time_index AS x, 'future' AS fit FROM cut UNION ALL SELECT series_id, ds, y, time_index, 'validation' FROM cut WHERE time_index < start),
  dm AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM fits WINDOW w AS (PARTITION BY series_id, fit, isodow(ds))),
  sl AS (SELECT series_id, fit, count(*) AS n, sum(dx * dy) / sum(dx * dx) AS b FROM dm GROUP BY 1, 2),
  lv AS (SELECT f.series_id, f.fit, isodow(ds) AS dow, avg(y) - any_value(b) * avg(x) AS a FROM fits f JOIN sl ON f.series_id = sl.series_id AND f.fit = sl.fit GROUP BY 1, 2, 3),
  rs AS (SELECT dm.series_id, dm.fit, sqrt(avg((dy - b * dx) * (dy - b * dx))) AS s FROM dm JOIN sl ON dm.series_id = sl.series_id AND dm.fit = sl.fit GROUP BY 1, 2),
  pts AS (SELECT series_id, 'validation' AS part, ds AS forecast_date, y AS actual, time_index AS x FROM cut WHERE time_index >= start
    UNION ALL SELECT series_id, 'future', CAST(last_ds + CAST(k AS INTEGER) AS DATE), NULL, n + k - 1 FROM (SELECT series_id, max(ds) AS last_ds, count(*) AS n FROM idx GROUP BY 1), generate_series(1, {horizon}) g(k)),
  wk AS (SELECT p.series_id, p.part, p.forecast_date, p.actual, lv.a + sl.b * p.x AS predicted, 1.2815515655446004 * rs.s AS margin FROM pts p
    JOIN sl ON sl.series_id = p.series_id AND sl.fit = p.part JOIN rs ON rs.series_id = p.series_id AND rs.fit = p.part
    JOIN lv ON lv.series_id = p.series_id AND lv.fit = p.part AND lv.dow = isodow(p.forecast_date))"""
)


@BOOK.add(
    "e05_weekly_pattern",
    f"""WITH {WEEKLY.format(horizon=14)} SELECT series_id, part, forecast_date, round(predicted, 3) AS predicted, round(predicted - margin, 3) AS lower_bound,
        round(predicted + margin, 3) AS upper_bound FROM wk""",
)
def _weekly(t: Tables) -> DataFrame:
    rows = op.weekly_predictions(split(dense(t)), horizon=14)
    margin = F.col("weekly_margin")
    return rows.select(
        "series_id",
        "part",
        "forecast_date",
        F.round("predicted", 3).alias("predicted"),
        F.round(F.col("predicted") - margin, 3).alias("lower_bound"),
        F.round(F.col("predicted") + margin, 3).alias("upper_bound"),
    )


@BOOK.add(
    "a14_weekly_errors",
    f"""WITH {WEEKLY.format(horizon=14)} SELECT series_id, round(avg(abs(actual - predicted)), 3) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS rmse,
        round(avg(abs((actual - predicted) / actual)) FILTER (actual <> 0) * 100, 3) AS mape FROM wk WHERE part = 'validation' GROUP BY 1""",
)
def _weekly_errors(t: Tables) -> DataFrame:
    rows = op.weekly_predictions(split(dense(t)), horizon=14).filter(F.col("part") == "validation")
    return op.error_metrics(rows, "series_id").select("series_id", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "mape")])


# The lag regression: centred sums of products, elimination row by row, then day after day.
REGRESSION = """,
  feat AS (SELECT *, lag(y, 1) OVER o AS l1, lag(y, 7) OVER o AS l7, avg(y) OVER p AS m7, stddev_samp(y) OVER p AS s7 FROM cut
    WINDOW o AS (PARTITION BY series_id ORDER BY ds), p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
  rf AS (SELECT series_id, fit, time_index AS t, [l1, l7, m7, s7, isodow(ds) - 1, month(ds), time_index, y]::DOUBLE[] AS x
    FROM feat JOIN (VALUES ('future'), ('validation')) f(fit) ON fit = 'future' OR time_index < start WHERE time_index >= 7),
  lng AS (SELECT series_id, fit, t, unnest(range(1, 9)) AS j, unnest(x) AS v FROM rf),
  mean AS (SELECT series_id, fit, j, avg(v) AS m FROM lng GROUP BY ALL),
  cen AS (SELECT l.series_id, l.fit, t, l.j, v - m AS c FROM lng l JOIN mean e ON l.series_id = e.series_id AND l.fit = e.fit AND l.j = e.j),
  cov AS (SELECT a.series_id, a.fit, a.j, b.j AS k, sum(a.c * b.c) AS s FROM cen a JOIN cen b ON a.series_id = b.series_id AND a.fit = b.fit AND a.t = b.t GROUP BY ALL),
  sd AS (SELECT series_id, fit, j, CASE WHEN j < 8 THEN sqrt(s) ELSE 1.0 END AS d FROM cov WHERE j = k),
  mat AS (SELECT c.series_id, c.fit, c.j, list(CASE WHEN r.d * q.d > 0 THEN s / (r.d * q.d) ELSE 0.0 END ORDER BY c.k) AS row_ FROM cov c
    JOIN sd r ON r.series_id = c.series_id AND r.fit = c.fit AND r.j = c.j JOIN sd q ON q.series_id = c.series_id AND q.fit = c.fit AND q.j = c.k
    WHERE c.j < 8 GROUP BY ALL),
  elim AS (SELECT series_id, fit, 1 AS k, list(row_ ORDER BY j) AS m FROM mat GROUP BY ALL
    UNION ALL SELECT series_id, fit, k + 1, [CASE WHEN i = k THEN u ELSE [m[i][j] - m[i][k] * u[j] FOR j IN range(1, 9)] END FOR i IN range(1, 8)]
    FROM (SELECT *, [CASE WHEN m[k][k] > 1e-10 THEN m[k][j] / m[k][k] ELSE 0.0 END FOR j IN range(1, 9)] AS u FROM elim WHERE k <= 7)),
  wts AS (SELECT e.series_id, e.fit, list(CASE WHEN d > 0 THEN m[j][8] / d ELSE 0.0 END ORDER BY j) AS w FROM elim e JOIN sd USING (series_id, fit)
    WHERE k = 8 AND j < 8 GROUP BY ALL),
  model AS (SELECT w.series_id, w.fit, any_value(w) AS w, sum(CASE WHEN j = 8 THEN m ELSE -m * w[j] END) AS base FROM wts w JOIN mean USING (series_id, fit) GROUP BY 1, 2),
  known AS (SELECT series_id, fit, max(ds) AS last_ds, count(*) AS periods, list(y ORDER BY ds)[-7:] AS week,
      CASE WHEN fit = 'future' THEN {horizon} ELSE any_value(n) - count(*) END AS steps
    FROM cut JOIN (VALUES ('future'), ('validation')) f(fit) ON fit = 'future' OR time_index < start GROUP BY 1, 2),
  walk AS (SELECT series_id, fit, 0 AS k, week FROM known
    UNION ALL SELECT a.series_id, a.fit, a.k + 1, list_append(a.week[2:], m.base + list_inner_product(m.w, [a.week[7], a.week[1], list_avg(a.week), list_stddev_samp(a.week),
        isodow(o.last_ds + CAST(a.k + 1 AS INTEGER)) - 1, month(o.last_ds + CAST(a.k + 1 AS INTEGER)), o.periods + a.k]::DOUBLE[]))
    FROM walk a JOIN model m ON m.series_id = a.series_id AND m.fit = a.fit JOIN known o ON o.series_id = a.series_id AND o.fit = a.fit WHERE a.k < o.steps),
  rg AS (SELECT a.series_id, a.fit AS part, CAST(o.last_ds + CAST(a.k AS INTEGER) AS DATE) AS forecast_date, c.y AS actual, a.week[7] AS predicted
    FROM walk a JOIN known o ON o.series_id = a.series_id AND o.fit = a.fit LEFT JOIN cut c ON a.fit = 'validation' AND c.series_id = a.series_id AND c.ds = o.last_ds + CAST(a.k AS INTEGER)
    WHERE a.k > 0)"""

BOTH = WEEKLY + REGRESSION + """,
  pred AS (SELECT series_id, part, forecast_date, actual, 'weekly' AS model, predicted, margin FROM wk
    UNION ALL SELECT series_id, part, forecast_date, actual, 'regression', predicted, NULL FROM rg),
  err AS (SELECT series_id, model, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae,
    stddev_pop(actual - predicted) AS s FROM pred WHERE part = 'validation' GROUP BY 1, 2),
  best AS (SELECT series_id, arg_min(model, (rmse, mae, model)) AS model FROM err GROUP BY 1),
  chosen AS (SELECT pred.*, coalesce(margin, 1.96 * err.s) AS width FROM pred JOIN best USING (series_id, model) JOIN err USING (series_id, model))"""


@BOOK.add(
    "e04_lag_regression",
    f"WITH RECURSIVE {(CUT + REGRESSION).format(horizon=14)} SELECT series_id, part, forecast_date, round(actual - predicted, 2) AS gap, round(predicted, 2) AS predicted FROM rg",
)
def _regression(t: Tables) -> DataFrame:
    rows = lag_regression(split_daily(dense(t)), horizon=14)
    return rounded(rows.withColumn("gap", F.col("actual") - F.col("predicted")).drop("actual"), "gap", "predicted", digits=2)


@BOOK.add(
    "e08_backtest_forecast",
    f"""WITH RECURSIVE {BOTH.format(horizon=7)} SELECT series_id, forecast_date, CAST(NULL AS DOUBLE) AS actual, round(predicted, 2) AS predicted,
        round(predicted - width, 2) AS lower_bound, round(predicted + width, 2) AS upper_bound, model FROM chosen WHERE part = 'future'""",
)
def _backtest(t: Tables) -> DataFrame:
    return rounded(op.chosen_forecast(op.backtest(dense(t), horizon=7)), "predicted", "lower_bound", "upper_bound", digits=2)


@BOOK.add(
    "e08_backtest_validation",
    f"""WITH RECURSIVE {BOTH.format(horizon=7)} SELECT series_id, forecast_date, round(actual - predicted, 2) AS gap, round(predicted, 2) AS predicted, model
        FROM chosen WHERE part = 'validation'""",
)
def _validation(t: Tables) -> DataFrame:
    rows = op.chosen_validation(op.backtest(dense(t), horizon=7))
    return rounded(rows.withColumn("gap", F.col("actual") - F.col("predicted")).drop("actual"), "gap", "predicted", digits=2)


@BOOK.add("o06_best_model", f"WITH RECURSIVE {BOTH.format(horizon=7)} SELECT series_id, model AS best_model FROM best")
def _best(t: Tables) -> DataFrame:
    rows = op.predictions(dense(t), horizon=7).filter(F.col("part") == "validation")
    return op.best_model(op.error_metrics(rows, "series_id", "model"), "series_id")


_UPLOAD = """
WITH src AS (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS y FROM orders),
  win AS (SELECT d, y, row_number() OVER (ORDER BY d, y) - 1 AS pos FROM (SELECT * FROM src ORDER BY d DESC, y DESC LIMIT 7)),
  line AS (SELECT max(d) AS last_ds, regr_slope(y, pos) FILTER (pos < 5) AS b, regr_intercept(y, pos) FILTER (pos < 5) AS a FROM win),
  score AS (SELECT stddev_pop(y - (a + b * pos)) AS s FROM win, line WHERE pos >= 5)
SELECT d AS date, round(y, 4) AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM win
UNION ALL SELECT CAST(last_ds + CAST(k AS INTEGER) AS DATE), NULL, round(a + b * (6 + k), 4), round(a + b * (6 + k) - 1.96 * s, 4),
  round(a + b * (6 + k) + 1.96 * s, 4) FROM line, score, generate_series(1, 14) g(k)
"""


@BOOK.add("e10_upload_job", _UPLOAD)
def _upload(t: Tables) -> DataFrame:
    """The whole upload job over the orders as text, layers and manifest written on the way."""
    source = t.orders.select(
        F.col("o_orderkey").cast("string").alias("Order Ref"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_totalprice").cast("string").alias("Total Price"),
    )
    result = run_upload(source, "orders.csv", date="Order Date", target="Total Price", horizon=14)
    return rounded(result.forecast, "actual", "forecast", "lower_bound", "upper_bound")
