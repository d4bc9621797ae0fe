"""Lag regression as aggregates and folds.

The model predicts a day from the day before, the same weekday before, mean and
deviation of the last seven days, weekday, month and place in the series. Means and
covariances of the features are one aggregate per series, so they are added up in
the tasks that hold the rows, and a long series is spread over blocks of days.
The normal equations are solved inside one expression per series, and every
prediction feeds the next one in a fold over the last seven values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.functions.values import let, rest

FEATURES = ("lag_1", "lag_7", "rolling_mean_7", "rolling_std_7", "day_of_week", "month", "time_index")
WEEK = 7
# Days of one block of a series.
BLOCK = 4096
# A feature of which less than this share of the variance is its own adds nothing to those before it.
OWN_SHARE = 1e-10


def lag_features(marked: DataFrame) -> DataFrame:
    """Features of each row, null in the first seven of a series, and ``week``, its last seven values.

    ``marked`` has series_id, ds, y and a gapless ``time_index``. Windows run over blocks of
    rows; the last seven of a block are shown to the next one too.
    """
    block = F.floor(F.col("time_index") / BLOCK)
    last = F.when(F.col("time_index") % BLOCK >= BLOCK - WEEK, block + 1)
    shown = marked.withColumn("block", F.explode(F.array_compact(F.array(block, last))))
    ordered = W.partitionBy("series_id", "block").orderBy("time_index")
    past = ordered.rowsBetween(-WEEK, -1)
    full = F.lag("y", WEEK).over(ordered).isNotNull()
    columns = {
        "lag_1": F.lag("y", 1).over(ordered),
        "lag_7": F.lag("y", WEEK).over(ordered),
        "rolling_mean_7": F.avg("y").over(past),
        "rolling_std_7": F.stddev_samp("y").over(past),
        "day_of_week": F.weekday("ds").cast("double"),
        "month": F.month("ds").cast("double"),
    }
    found = shown.withColumns({name: F.when(full, value) for name, value in columns.items()} | {"week": F.collect_list("y").over(ordered.rowsBetween(1 - WEEK, 0))})
    return found.filter(F.col("block") == block).drop("block")


def moments(names: Sequence[str], target: str) -> list[Column]:
    """Aggregates: ``means`` of the features and the target, ``spread``, the upper rows of their covariances.

    Rows in which a feature is null must lack the others too.
    """
    every = [*names, target]
    means = F.array(*[F.avg(c) for c in every]).alias("means")
    pairs = F.array(*[F.covar_pop(a, b) for i, a in enumerate(every[:-1]) for b in every[i:]]).alias("spread")
    return [means, pairs]


def _matrix(spread: Column, size: int) -> Column:
    """Covariances of the features, each row followed by that with the target."""
    place, places = 0, {}
    for i in range(size):
        for j in range(i, size + 1):
            places[i, j] = place
            place += 1
    return F.array(*[F.array(*[spread[places[min(i, j), max(i, j)]] for j in range(size + 1)]) for i in range(size)])


def solve(matrix: Column, size: int) -> Column:
    """Solution of the symmetric system whose rows end with their right side.

    Rows and columns are scaled to a unit diagonal and eliminated one after another; a positive
    definite matrix needs no exchange of rows. A row that those before it explain counts as zero.
    """

    def scaled(m: Column) -> Column:
        return let(
            F.transform(m, lambda row, i: F.sqrt(F.greatest(row[i], F.lit(0.0)))),
            lambda size_of: F.struct(
                size_of.alias("scale"),
                F.transform(
                    m,
                    lambda row, i: F.transform(
                        row, lambda x, j: F.coalesce(F.try_divide(x, size_of[i] * F.coalesce(F.get(size_of, j), F.lit(1.0))), F.lit(0.0))
                    ),
                ).alias("rows"),
            ),
        )

    def step(m: Column, k: Column) -> Column:
        def cleared(unit: Column) -> Column:
            return F.transform(m, lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda x, u: x - row[k] * u)))

        pivot = m[k][k]
        return let(F.transform(m[k], lambda x: F.when(pivot > OWN_SHARE, x / pivot).otherwise(0.0)), cleared)

    def solved(s: Column) -> Column:
        done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), s["rows"], step)
        return F.transform(done, lambda row, i: F.coalesce(F.try_divide(row[size], s["scale"][i]), F.lit(0.0)))

    return let(scaled(matrix), solved)


def fitted(rows: DataFrame, keys: Sequence[str], names: Sequence[str] = FEATURES, target: str = "y", *more: Column) -> DataFrame:
    """keys, ``weights`` of the features, ``base``, and further aggregates; null weights where no row has all features."""
    known = F.col(names[0]).isNotNull()
    plain = rows.withColumns({f"_{c}": F.when(known, F.col(c).cast("double")) for c in (*names, target)})
    sums = plain.groupBy(*keys).agg(F.count_if(known).alias("fitted_rows"), *moments([f"_{c}" for c in names], f"_{target}"), *more)
    weighed = sums.withColumn("weights", F.when(F.col("fitted_rows") > 0, solve(_matrix(F.col("spread"), len(names)), len(names))))
    products = F.zip_with(F.slice("means", 1, len(names)), F.col("weights"), lambda m, w: m * w)
    base = F.element_at("means", len(names) + 1) - F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return weighed.withColumn("base", base).drop("means", "spread")


def fold_forward(steps: Column, week: Column, predict: Callable[[Column, Column], Column]) -> Column:
    """Predictions one after another; each replaces the oldest of the last seven values."""
    nothing = F.array().cast("array<double>")

    def step(state: Column, k: Column) -> Column:
        return let(
            predict(state["week"], k),
            lambda y: F.struct(F.concat(rest(state["week"]), F.array(y)).alias("week"), F.concat(state["out"], F.array(y)).alias("out")),
        )

    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(week.alias("week"), nothing.alias("out")), step, lambda s: s["out"])


def _next_value(last_ds: Column, periods: Column, base: Column, weights: Column) -> Callable[[Column, Column], Column]:
    def predict(week: Column, k: Column) -> Column:
        mean = F.aggregate(week, F.lit(0.0), lambda total, x: total + x) / WEEK

        def value(m: Column) -> Column:
            spread = F.sqrt(F.aggregate(week, F.lit(0.0), lambda total, x: total + (x - m) * (x - m)) / (WEEK - 1))
            day = F.date_add(last_ds, k.cast("int"))
            row = [week[WEEK - 1], week[0], m, spread, F.weekday(day), F.month(day), periods + k - 1]
            terms = F.zip_with(F.array(*[x.cast("double") for x in row]), weights, lambda x, w: x * w)
            return F.aggregate(terms, base, lambda total, x: total + x)

        return let(mean, value)

    return predict


def lag_regression(marked: DataFrame, horizon: int) -> DataFrame:
    """series_id, part, forecast_date, actual, predicted: validation days from the training part, future days from all rows.

    ``marked`` comes from ``series.split`` or ``series.split_daily``. A series with seven days or
    less before its first prediction has none.
    """
    fits = F.array_compact(F.array(F.lit("future"), F.when(F.col("part") == "train", F.lit("validation"))))
    rows = lag_features(marked).withColumn("fit", F.explode(fits))
    latest = F.max_by("week", "time_index").alias("week")
    models = fitted(rows, ["series_id", "fit"], FEATURES, "y", F.count(F.lit(1)).alias("periods"), F.max("ds").alias("last_ds"), latest)
    sizes = marked.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"))
    ahead = models.filter("fitted_rows > 0").join(sizes, "series_id")
    steps = F.when(F.col("fit") == "future", F.lit(horizon)).otherwise(F.col("days") - F.col("periods")).cast("int")
    next_value = _next_value(F.col("last_ds"), F.col("periods"), F.col("base"), F.col("weights"))
    folded = ahead.withColumn("steps", steps).filter("steps > 0").withColumn("out", fold_forward(F.col("steps"), F.col("week"), next_value))
    guessed = folded.select("series_id", F.col("fit").alias("part"), "last_ds", F.posexplode("out").alias("k", "predicted")).select(
        "series_id", "part", F.date_add("last_ds", F.col("k") + 1).alias("forecast_date"), "predicted"
    )
    held = marked.filter("part = 'validation'").select("series_id", "part", F.col("ds").alias("forecast_date"), F.col("y").alias("actual"))
    return guessed.join(held, ["series_id", "part", "forecast_date"], "left").select("series_id", "part", "forecast_date", "actual", "predicted")
