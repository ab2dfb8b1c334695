"""Seasonal forecasts against numpy, and the choice of the model."""

import math

import numpy as np
import pytest

from plumbline.operators import forecast, seasonal


def _frame(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "k string, i int, y double")


def _plain(values, period, pairs, horizon):
    """Least squares with waves written out; forecasts and the spread of the residuals."""
    terms = lambda t: [1.0, t, *(f(2 * math.pi * k * t / period) for k in range(1, pairs + 1) for f in (math.sin, math.cos)), *full * [(-1.0) ** t]]
    n, full = len(values), period % 2 == 0 and pairs == (period - 1) // 2
    matrix = np.array([terms(t) for t in range(n)])
    weights = np.linalg.lstsq(matrix, np.array(values), rcond=None)[0]
    spread = math.sqrt(np.mean((np.array(values) - matrix @ weights) ** 2))
    return [float(np.array(terms(t)) @ weights) for t in range(n, n + horizon)], 1.96 * spread


@pytest.mark.parametrize(("period", "pairs", "n"), [(7, None, 60), (12, 2, 30), (4, None, 9), (2, None, 12)])
def test_season_equals_least_squares(spark, period, pairs, n):
    rng = np.random.default_rng(n)
    values = (5 + 0.3 * np.arange(n) + 4 * np.sin(2 * math.pi * np.arange(n) / period) + rng.normal(0, 0.5, n)).tolist()
    series = forecast.numeric_series(_frame(spark, values), "y", ["i"])
    got = seasonal.seasonal_forecast(series, seasonal.fit_season(series, period, pairs), 10).orderBy("t").collect()
    want, margin = _plain(values, period, seasonal.wave_pairs(period, pairs), 10)
    assert [r["t"] for r in got] == list(range(n, n + 10))
    for r, value in zip(got, want):
        assert (r["forecast"], r["lower"], r["upper"]) == pytest.approx((value, value - margin, value + margin), abs=2e-6)


def test_many_series_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    series = {name: rng.normal(10, 3, n).tolist() for name, n in (("long", 900), ("b", 14), ("short", 13), ("c", 40))}
    df = None
    for name, values in series.items():
        df = _frame(spark, values, name) if df is None else df.union(_frame(spark, values, name))
    df = df.union(spark.createDataFrame([(None, 0, 1.0), ("b", 99, None)], df.schema))
    got = {(r["series"], r["step"]): r for r in seasonal.seasonal_many(df, "k", "y", ["i"], 7, horizon=8).collect()}
    assert {name for name, _ in got} == {"long", "b", "c"} and len(got) == 24
    for name in ("long", "b", "c"):
        want, margin = _plain(series[name], 7, 3, 8)
        for step, value in enumerate(want, 1):
            r = got[name, step]
            assert r["points"] == len(series[name])
            assert (r["forecast"], r["lower"], r["upper"]) == pytest.approx((value, value - margin, value + margin), abs=2e-4)


def test_choice_of_the_model(spark):
    waves = [10 + 5 * (i % 4) + 0.1 * i for i in range(60)]
    found = forecast.forecast(_frame(spark, waves), "y", ["i"], 4, forecast.SEASONAL, period=4).orderBy("t").collect()
    assert [r["forecast"] for r in found] == pytest.approx([10 + 5 * (i % 4) + 0.1 * i for i in range(60, 64)], abs=1e-6)
    assert {(r["model_used"], r["note"]) for r in found} == {(forecast.SEASONAL, None)}
    line = [3.0 * i for i in range(60)]
    noisy = [v + (i * 7919 % 13) for i, v in enumerate(line)]
    for values, note in ((noisy, seasonal.NO_GAIN), (line[:8], seasonal.TOO_SHORT)):
        found = forecast.forecast(_frame(spark, values), "y", ["i"], 2, forecast.SEASONAL, period=5).collect()
        assert {r["note"] for r in found} <= {note, None} and len(found) == 2
        if note == seasonal.TOO_SHORT:
            assert {(r["model_used"], r["note"]) for r in found} == {(forecast.LINEAR, note)}
    assert forecast.forecast(_frame(spark, line), "y", ["i"], 2, forecast.SEASONAL).first()["note"] == forecast.FALLBACK_NOTE


def test_errors(spark):
    series = forecast.numeric_series(_frame(spark, [1, 2, 3]), "y", ["i"])
    with pytest.raises(forecast.ForecastError):
        seasonal.fit_season(series, 7)
    with pytest.raises(forecast.ForecastError):
        seasonal.wave_pairs(1)
    season = seasonal.Season(3, 2, 0, (1.0, 0.0, 0.0))
    with pytest.raises(forecast.ForecastError):
        seasonal.seasonal_forecast(series, season, 0)
