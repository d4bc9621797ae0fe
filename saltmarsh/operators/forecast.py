"""Forecasts per series: short linear trend, lag regression, weekly pattern, back-test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.operators.regression import lag_regression
from saltmarsh.operators.series import last_rows, split_daily

Z95 = 1.96
Z80 = 1.2815515655446004
HORIZONS = (3, 7, 14, 30)
MAX_HORIZON = 365


def error_metrics(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean absolute error, root mean square error and percentage error without zero actuals."""
    return df.groupBy(*keys).agg(*error_columns(F.col(actual), F.col(predicted)))


def error_columns(actual: Column, predicted: Column) -> list[Column]:
    gap = actual - predicted
    return [
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.avg(F.when(actual != 0, F.abs(gap / actual))) * 100).alias("mape"),
    ]


def best_model(scores: DataFrame, *keys: str) -> DataFrame:
    """Lowest RMSE, then MAE, then name."""
    return scores.groupBy(*keys).agg(F.min_by("model", F.struct("rmse", "mae", "model")).alias("best_model"))


def holdout_size(rows: Column) -> Column:
    """Held-out rows of a short window: a third, between two and five, fewer for tiny windows."""
    third = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(rows / 3).cast("int")))
    half = F.greatest(F.lit(1), F.floor(rows / 2).cast("int"))
    return F.when(rows <= third + 2, half).otherwise(third)


def short_window(series: DataFrame, window: int = 7) -> DataFrame:
    """The last rows of every series with position, window size and holdout mark."""
    whole = W.partitionBy("series_id")
    recent = last_rows(series, window).withColumns(
        {
            "pos": F.row_number().over(whole.orderBy("ds", "y")) - 1,
            "rows": F.count(F.lit(1)).over(whole).cast("int"),
        }
    )
    return recent.withColumn("held_out", F.col("pos") >= F.col("rows") - holdout_size(F.col("rows")))


def trend_models(series: DataFrame, window: int = 7) -> DataFrame:
    """Line fitted on the first part of the window, scored on the held-out rest."""
    rows = short_window(series, window)
    train = ~F.col("held_out")
    lines = rows.groupBy("series_id").agg(
        F.max("rows").alias("record_count"),
        F.max("ds").alias("last_ds"),
        F.regr_slope(F.when(train, F.col("y")), F.when(train, F.col("pos"))).alias("slope"),
        F.regr_intercept(F.when(train, F.col("y")), F.when(train, F.col("pos"))).alias("intercept"),
        F.collect_list(F.when(F.col("held_out"), F.struct("pos", "y"))).alias("held"),
    )
    scored = lines.select(
        "series_id", "record_count", "last_ds", "slope", "intercept", F.explode("held").alias("h")
    ).withColumn("guess", F.col("intercept") + F.col("slope") * F.col("h.pos"))
    keys = ("series_id", "record_count", "last_ds", "slope", "intercept")
    return scored.groupBy(*keys).agg(
        *error_columns(F.col("h.y"), F.col("guess")),
        F.stddev_pop(F.col("h.y") - F.col("guess")).alias("residual_std"),
    )


def trend_forecast(series: DataFrame, horizon: int = 14, window: int = 7) -> DataFrame:
    """History rows of the window followed by the predicted days, null-padded."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must lie between 1 and {MAX_HORIZON}")
    history = last_rows(series, window).select("series_id", F.col("ds").alias("date"), F.col("y").alias("actual"))
    models = trend_models(series, window)
    too_short = F.raise_error("at least 3 valid rows are required to build a forecast").cast("double")
    ahead = models.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    line = F.col("intercept") + F.col("slope") * (F.col("record_count") + F.col("step") - 1)
    guess = F.when(F.col("record_count") < 3, too_short).otherwise(line)
    margin = Z95 * F.col("residual_std")
    future = ahead.select(
        "series_id",
        F.date_add("last_ds", F.col("step")).alias("date"),
        guess.alias("forecast"),
        (guess - margin).alias("lower_bound"),
        (guess + margin).alias("upper_bound"),
    )
    return history.unionByName(future, allowMissingColumns=True)


def weekly_models(rows: DataFrame, *keys: str) -> DataFrame:
    """Straight trend plus one level per weekday, by least squares.

    With weekday levels the common slope is the slope of the rows after their
    weekday means are taken off, so sums per weekday are all that is needed. The
    result has one row per key with slope, levels by weekday and residual deviation.
    """
    n = F.count(F.lit(1))
    days = rows.groupBy(*keys, F.weekday("ds").alias("dow")).agg(
        n.alias("n"),
        F.avg("time_index").alias("mean_t"),
        F.avg("y").alias("mean_y"),
        (F.covar_pop("time_index", "y") * n).alias("sty"),
        (F.var_pop("time_index") * n).alias("stt"),
        (F.var_pop("y") * n).alias("syy"),
    )
    sums = days.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("sty").alias("sty"),
        F.sum("stt").alias("stt"),
        F.sum("syy").alias("syy"),
        F.collect_list(F.struct("dow", "mean_y", "mean_t")).alias("days"),
    )
    slope = F.when(F.col("stt") > 0, F.col("sty") / F.col("stt")).otherwise(0.0)
    fitted = sums.withColumn("slope", slope)
    levels = F.transform("days", lambda d: F.struct(d["dow"], (d["mean_y"] - F.col("slope") * d["mean_t"]).alias("level")))
    spread = F.greatest(F.col("syy") - F.col("slope") * F.col("sty"), F.lit(0.0)) / F.col("n")
    return fitted.select(
        *keys, F.col("n").alias("periods"), "slope", F.map_from_entries(levels).alias("levels"), F.sqrt(spread).alias("residual_std")
    )


def _weekly_value(time_index: Column, day: Column) -> Column:
    return F.element_at("levels", F.weekday(day)) + F.col("slope") * time_index


def weekly_predictions(marked: DataFrame, horizon: int) -> DataFrame:
    """Validation rows predicted from the training part and future rows predicted from all rows.

    ``marked`` comes from :func:`saltmarsh.operators.series.split`.
    """
    fits = F.array(F.lit("future"), F.when(F.col("part") == "train", F.lit("validation")))
    labelled = marked.select("*", F.explode(F.array_compact(fits)).alias("fit"))
    models = weekly_models(labelled, "series_id", "fit")
    held = marked.filter(F.col("part") == "validation").join(models.filter(F.col("fit") == "validation"), "series_id")
    margin = (Z80 * F.col("residual_std")).alias("weekly_margin")
    checked = held.select(
        "series_id",
        "part",
        F.col("ds").alias("forecast_date"),
        F.col("y").alias("actual"),
        F.lit("weekly").alias("model"),
        _weekly_value(F.col("time_index"), F.col("ds")).alias("predicted"),
        margin,
    )
    last = marked.groupBy("series_id").agg(F.max("ds").alias("last_ds"))
    ahead = models.filter(F.col("fit") == "future").join(last, "series_id")
    steps = ahead.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    day = F.date_add("last_ds", F.col("step"))
    future = steps.select(
        "series_id",
        F.lit("future").alias("part"),
        day.alias("forecast_date"),
        F.lit(None).cast("double").alias("actual"),
        F.lit("weekly").alias("model"),
        _weekly_value(F.col("periods") + F.col("step") - 1, day).alias("predicted"),
        margin,
    )
    return checked.unionByName(future)


def regression_predictions(marked: DataFrame, horizon: int) -> DataFrame:
    """Lag regression per series, with the columns of :func:`weekly_predictions`."""
    return lag_regression(marked, horizon).withColumns({"model": F.lit("regression"), "weekly_margin": F.lit(None).cast("double")})


def predictions(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Validation and future predictions of both models."""
    marked = split_daily(series)
    return weekly_predictions(marked, horizon).unionByName(regression_predictions(marked, horizon))


def backtest(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Predictions with each model's errors and the model chosen for the series."""
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    rows = predictions(series, horizon)
    per_model = W.partitionBy("series_id", "model")
    checked = F.when(F.col("part") == "validation", F.col("actual"))
    gap = checked - F.col("predicted")
    scored = rows.withColumns(
        {
            "mae": F.avg(F.abs(gap)).over(per_model),
            "rmse": F.sqrt(F.avg(gap * gap).over(per_model)),
            "mape": F.avg(F.when(checked != 0, F.abs(gap / checked))).over(per_model) * 100,
            "residual_std": F.stddev_pop(gap).over(per_model),
        }
    )
    rank = F.struct("rmse", "mae", "model")
    return scored.withColumn("best_model", F.min(rank).over(W.partitionBy("series_id"))["model"])


def evaluation(tested: DataFrame) -> DataFrame:
    return tested.groupBy("series_id", "model").agg(
        *[F.first(c).alias(c) for c in ("mae", "rmse", "mape", "best_model")]
    )


def chosen_forecast(tested: DataFrame) -> DataFrame:
    """Future rows of the chosen model with its interval."""
    margin = F.coalesce(F.col("weekly_margin"), Z95 * F.col("residual_std"))
    return tested.filter((F.col("part") == "future") & (F.col("model") == F.col("best_model"))).select(
        "series_id",
        "forecast_date",
        F.lit(None).cast("double").alias("actual"),
        "predicted",
        (F.col("predicted") - margin).alias("lower_bound"),
        (F.col("predicted") + margin).alias("upper_bound"),
        "model",
    )


def chosen_validation(tested: DataFrame) -> DataFrame:
    return tested.filter((F.col("part") == "validation") & (F.col("model") == F.col("best_model"))).select(
        "series_id", "forecast_date", "actual", "predicted", "model"
    )
