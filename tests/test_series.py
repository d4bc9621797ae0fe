import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saltmarsh.operators import forecast as fc, series as se


def frame(spark, values, start="2024-01-01", skip=()):
    day = dt.date.fromisoformat(start)
    rows = [("s", day + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def test_interpolation_matches_pandas(spark):
    values = np.random.default_rng(1).normal(100, 20, 60)
    gaps = {3, 4, 5, 17, 40, 41}
    got = se.interpolate(frame(spark, values, skip=gaps)).orderBy("ds").toPandas()
    days = pd.date_range("2024-01-01", periods=60, freq="D")
    want = pd.Series([np.nan if i in gaps else v for i, v in enumerate(values)], index=days).interpolate("time")
    assert np.allclose(got["y"], want)
    assert set(np.flatnonzero(got["filled"])) == gaps


def test_short_series(spark):
    raw = frame(spark, range(10)).select("ds", "y", F.lit("a").alias("k"))
    with pytest.raises(PySparkException, match="at least 30"):
        se.prepare(raw, "ds", "y", "k").collect()
    assert se.prepare(raw, "ds", "y", "k", short="skip").count() == 0


def test_constant_series_has_no_outliers_and_is_flat(spark):
    flat = frame(spark, [5.0] * 20)
    assert se.outliers(flat).first()["outlier_count"] == 0
    assert se.trend(flat).first()["direction"] == "flat"


def test_metrics_skip_zero_actuals(spark):
    rows = spark.createDataFrame([("m", 0.0, 1.0), ("m", 10.0, 8.0), ("z", 0.0, 1.0)], "model string, actual double, predicted double")
    found = {r["model"]: r for r in fc.error_metrics(rows, "model").collect()}
    assert found["m"]["mape"] == pytest.approx(20.0) and found["m"]["mae"] == pytest.approx(1.5)
    assert found["z"]["mape"] is None


@pytest.mark.parametrize("n,held", [(3, 1), (4, 2), (5, 2), (6, 2), (7, 2), (20, 2)])
def test_short_trend(spark, n, held):
    values = np.random.default_rng(n).normal(50, 5, n)
    window = values[-7:]
    rows = fc.trend_forecast(frame(spark, values), horizon=5).orderBy("date").toPandas()
    k = len(window) - held
    slope, base = np.polyfit(np.arange(k), window[:k], 1)
    future = base + slope * np.arange(len(window), len(window) + 5)
    errors = window[k:] - (base + slope * np.arange(k, len(window)))
    assert np.allclose(rows["forecast"].dropna(), future)
    assert np.allclose(rows["upper_bound"].dropna(), future + 1.96 * np.std(errors))
    assert len(rows) == len(window) + 5


def test_trend_needs_three_rows(spark):
    with pytest.raises(PySparkException, match="at least 3"):
        fc.trend_forecast(frame(spark, [1, 2]), horizon=2).collect()
    with pytest.raises(ValueError):
        fc.trend_forecast(frame(spark, [1, 2, 3]), horizon=0)


def plain_regression(y, first, horizon):
    """The lag regression written out row by row, solved by normal equations."""
    days = pd.date_range(first, periods=len(y) + horizon, freq="D")

    def features(known, i):
        week = known[i - 7 : i]
        return [known[i - 1], known[i - 7], np.mean(week), np.std(week, ddof=1), days[i].dayofweek, days[i].month, i]

    x = np.array([features(y, i) for i in range(7, len(y))])
    design = np.column_stack([np.ones(len(x)), x])
    weights = np.linalg.pinv(design.T @ design) @ design.T @ y[7:]
    known = list(y)
    for i in range(len(y), len(y) + horizon):
        known.append(float(weights @ np.r_[1, features(known, i)]))
    return np.array(known[len(y) :])


def sample(n=120):
    rng = np.random.default_rng(5)
    return 200 + np.arange(n) * 0.7 + 30 * (np.arange(n) % 7 == 2) + rng.normal(0, 8, n)


def test_regression_matches_plain_form(spark):
    y = sample()
    rows = fc.predictions(frame(spark, y), 14).filter("model = 'regression' AND part = 'future'").orderBy("forecast_date").toPandas()
    assert np.allclose(rows["predicted"], plain_regression(y, "2024-01-01", 14), rtol=1e-4)


def test_weekly_finds_pattern(spark):
    n = 70
    y = 100 + 0.5 * np.arange(n) + 20 * (np.arange(n) % 7 == 3)
    rows = fc.predictions(frame(spark, y), 7).filter("model = 'weekly' AND part = 'future'").orderBy("forecast_date").toPandas()
    later = np.arange(n, n + 7)
    assert np.allclose(rows["predicted"], 100 + 0.5 * later + 20 * (later % 7 == 3))


def test_backtest_chooses_lower_error(spark):
    tested = fc.backtest(frame(spark, sample()), 7)
    scores = {r["model"]: r for r in fc.evaluation(tested).collect()}
    best = min(scores, key=lambda m: (scores[m]["rmse"], scores[m]["mae"], m))
    chosen = fc.chosen_forecast(tested).collect()
    assert {r["model"] for r in chosen} == {best} and len(chosen) == 7
    assert all(r["lower_bound"] <= r["predicted"] <= r["upper_bound"] and r["actual"] is None for r in chosen)
    assert fc.chosen_validation(tested).count() == 24
    with pytest.raises(ValueError):
        fc.backtest(frame(spark, sample()), 8)


def test_regression_over_blocks_of_days(spark, monkeypatch):
    """A series in blocks of twenty days gives what it gives in one."""
    from saltmarsh.operators import regression

    marked = se.split_daily(frame(spark, sample(90)))
    whole = {(r.part, r.forecast_date): r.predicted for r in regression.lag_regression(marked, 9).collect()}
    monkeypatch.setattr(regression, "BLOCK", 20)
    cut = {(r.part, r.forecast_date): r.predicted for r in regression.lag_regression(marked, 9).collect()}
    assert len(whole) == 18 + 9 and whole.keys() == cut.keys()
    assert all(cut[k] == pytest.approx(v, rel=1e-7) for k, v in whole.items())


def test_regression_of_a_straight_line(spark):
    """Features that say the same are counted once; the line goes on."""
    y = 3.0 * np.arange(40) + 7
    rows = fc.regression_predictions(se.split_daily(frame(spark, y)), 5).filter("part = 'future'").orderBy("forecast_date").toPandas()
    assert np.allclose(rows["predicted"], 3.0 * np.arange(40, 45) + 7, rtol=1e-6)


def test_solve(spark):
    from saltmarsh.operators.regression import solve

    draw = np.random.default_rng(3)
    rows = []
    for i in range(5):
        half = draw.normal(size=(9, 4))
        half[:, 2] *= 1e4
        a = half.T @ half
        x = draw.normal(size=4)
        rows.append((i, np.column_stack([a, a @ x]).tolist(), x.tolist()))
    singular = np.array([[2.0, 2.0, 4.0], [2.0, 2.0, 4.0]])
    got = spark.createDataFrame(rows, "i int, m array<array<double>>, x array<double>").select("x", solve(F.col("m"), 4).alias("s")).collect()
    assert all(np.allclose(r.x, r.s, rtol=1e-6) for r in got)
    got = spark.createDataFrame([(singular.tolist(),)], "m array<array<double>>").select(solve(F.col("m"), 2).alias("s")).first()
    assert np.allclose(got.s, [2.0, 0.0])


def test_split_by_dates(spark):
    series = frame(spark, sample(100))
    columns = ["series_id", "ds", "y", "time_index", "part"]
    assert sorted(map(tuple, se.split(series).select(*columns).collect())) == sorted(map(tuple, se.split_daily(series).select(*columns).collect()))
    with pytest.raises(Exception, match="days are missing"):
        se.split_daily(series.filter(F.dayofmonth("ds") != 9)).collect()
