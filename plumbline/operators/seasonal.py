"""Seasonal forecasts: least squares on a trend and waves of a period, as sums.

The model of position ``t`` is a line plus ``pairs`` pairs of sine and cosine whose periods are ``period``,
``period / 2``, ... Its normal equations are sums of products over the rows, so one aggregate gives
them whatever the number of rows, and a few numbers per series are solved. Whether the waves help is decided by
the error on the last rows, which neither model has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import py_round
from plumbline.operators.forecast import BAND, LINEAR, MAX_HORIZON, SEASONAL, ForecastError, fit_line, linear_forecast, target_value
from plumbline.operators.row_index import PART, PLACE, sorted_positions
from plumbline.session import let_workers_import, materialize

#: Rows held out to compare models: one in so many, the last ones.
HELD_OUT = 5
TOO_SHORT = "The series has fewer than two periods; used linear regression instead."
NO_GAIN = "The seasonal model was not better on the last rows; used linear regression instead."


def wave_pairs(period: int, pairs: int | None = None) -> int:
    """How many pairs of waves a whole period tells apart, at most ``pairs``."""
    if period < 2:
        raise ForecastError("a period needs two points at least")
    most = (period - 1) // 2
    return most if pairs is None else min(most, pairs)


def _terms(t: Column, n: Column, period: int, pairs: int) -> list[Column]:
    """1, the position between -1/2 and 1/2, and the waves. The position's remainder keeps the angles small."""
    angle = F.pmod(t, F.lit(period)).cast("double") * (2 * math.pi / period)
    waves = [wave for k in range(1, pairs + 1) for wave in (F.sin(angle * k), F.cos(angle * k))]
    if period % 2 == 0 and pairs == wave_pairs(period):  # the shortest wave of an even period goes up and down
        waves.append(F.when(F.pmod(t, F.lit(2)) == 0, 1.0).otherwise(-1.0))
    return [F.lit(1.0), (t.cast("double") - (n - 1) / 2) / n, *waves]


def _products(terms: list[Column], y: Column) -> list[Column]:
    """Sums of the products of all pairs of terms, then of each with ``y``."""
    size = range(len(terms))
    return [F.sum(terms[i] * terms[j]).alias(f"p{i}_{j}") for i in size for j in size if i <= j] + [F.sum(term * y).alias(f"r{i}") for i, term in enumerate(terms)]


def _solve(sums: np.ndarray, size: int) -> np.ndarray:
    """Weights of many series (rows of product sums); the least ones where several fit as well."""
    normal = np.zeros((len(sums), size, size))
    upper = np.triu_indices(size)
    normal[:, upper[0], upper[1]] = sums[:, : len(upper[0])]
    normal[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
    return np.einsum("sij,sj->si", np.linalg.pinv(normal, rcond=1e-12, hermitian=True), sums[:, len(upper[0]) :])


@dataclass(frozen=True)
class Season:
    points: int
    period: int
    pairs: int
    weights: tuple[float, ...]

    def at(self, t: Column) -> Column:
        terms = _terms(t, F.lit(float(self.points)), self.period, self.pairs)
        return sum((term * w for term, w in zip(terms, self.weights)), F.lit(0.0))


def fit_season(series: DataFrame, period: int, pairs: int | None = None, points: int | None = None) -> Season:
    """Fit ``(t, y)`` with t = 0, 1, 2, ...; some dozen numbers reach the driver."""
    pairs = wave_pairs(period, pairs)
    n = series.count() if points is None else points
    if n < 2 * period:
        raise ForecastError(f"a season of {period} points needs {2 * period} of them, not {n}")
    terms = _terms(F.col("t"), F.lit(float(n)), period, pairs)
    sums = np.array([series.agg(*_products(terms, F.col("y"))).first()], dtype=np.float64)
    return Season(n, period, pairs, tuple(_solve(sums, len(terms))[0].tolist()))


def seasonal_forecast(series: DataFrame, season: Season, horizon: int = 30) -> DataFrame:
    """Rows ``(t, forecast, lower, upper)`` for the next positions; the band comes from a pass over the residuals."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ForecastError(f"horizon must be between 1 and {MAX_HORIZON}")
    residual = F.col("y") - season.at(F.col("t"))
    margin = series.agg((F.sqrt(F.avg(residual * residual)) * BAND).alias("margin"))
    steps = F.sequence(F.lit(season.points), F.lit(season.points + horizon - 1)).cast("array<bigint>")
    ahead = margin.select(F.explode(steps).alias("t"), "margin").withColumn("value", season.at(F.col("t")))
    return ahead.select("t", *_band(F.col("value"), F.col("margin"), 6))


def _band(value: Column, margin: Column, digits: int) -> list[Column]:
    return [py_round(c, digits).alias(name) for name, c in (("forecast", value), ("lower", value - margin), ("upper", value + margin))]


def compare_models(series: DataFrame, period: int, pairs: int | None = None) -> DataFrame:
    """One row ``(model_used, line_error, season_error, note)``: mean absolute errors on the last rows of models fitted without them."""
    n = series.count()
    kept = n - max(1, n // HELD_OUT)
    if kept < 2 * period:
        spark = series.sparkSession
        return spark.createDataFrame([(LINEAR, None, None, TOO_SHORT)], "model_used string, line_error double, season_error double, note string")
    past = series.where(F.col("t") < kept)
    line, season = fit_line(past), fit_season(past, period, pairs, kept)
    errors = series.where(F.col("t") >= kept).agg(
        F.avg(F.abs(F.col("y") - line.at(F.col("t")))).alias("line"), F.avg(F.abs(F.col("y") - season.at(F.col("t")))).alias("season")
    )
    better = F.col("season") < F.col("line")
    return errors.select(
        F.when(better, SEASONAL).otherwise(LINEAR).alias("model_used"),
        py_round(F.col("line"), 6).alias("line_error"),
        py_round(F.col("season"), 6).alias("season_error"),
        F.when(~better, F.lit(NO_GAIN)).alias("note"),
    )


def forecast_with_season(series: DataFrame, period: int, horizon: int = 30, target: str = "y") -> DataFrame:
    """Forecast rows of the better model with its name and, where it is not the seasonal one, a note on the reason."""
    chosen = compare_models(series, period).first()
    if chosen["model_used"] == SEASONAL:
        rows = seasonal_forecast(series, fit_season(series, period), horizon)
    else:
        rows = linear_forecast(series, fit_line(series, target), horizon)
    return rows.withColumns({"model_used": F.lit(chosen["model_used"]), "note": F.lit(chosen["note"]).cast("string")})


def seasonal_many(df: DataFrame, key: str, target: str, order_by: Sequence[str], period: int, horizon: int = 1, pairs: int | None = None) -> DataFrame:
    """Seasonal forecasts of all series: (series, points, step, forecast, lower, upper), none for a series of fewer than two periods.

    As in ``forecast_many``, rows are range-partitioned by series and order, so a large series spans
    many partitions; every slice gives its sums, and no series is gathered. A second pass adds up the residuals.
    """
    if not 1 <= horizon <= MAX_HORIZON:
        raise ForecastError(f"horizon must be between 1 and {MAX_HORIZON}")
    let_workers_import(df.sparkSession)
    pairs = wave_pairs(period, pairs)
    rows = df.select(F.col(f"`{key}`").alias("__series"), target_value(df, target).alias("__y"), *order_by)
    numbers = rows.where(F.col("__series").isNotNull() & F.col("__y").isNotNull())
    # All passes must see the same slices, so the tagged rows are written.
    tagged = materialize(sorted_positions(numbers, ["__series", *order_by]).select("__series", "__y", PART, PLACE), "seasons")
    slices = tagged.groupBy("__series", PART).agg(F.count("*").alias("rows"), F.min(PLACE).alias("start"))
    before = Window.partitionBy("__series").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("__series")
    placed = slices.select(
        "__series", PART, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("start")).alias("shift"), F.sum("rows").over(every).alias("n")
    ).where(F.col("n") >= 2 * period)
    placed = materialize(placed, "season-slices")
    positioned = tagged.join(placed, ["__series", PART]).withColumn("t", F.col(PLACE) + F.col("shift"))
    terms = _terms(F.col("t"), F.col("n").cast("double"), period, pairs)
    size = len(terms)
    sums = positioned.groupBy("__series", "n").agg(F.array(*_products(terms, F.col("__y"))).alias("sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            weights = _solve(flat, size).reshape(-1) if batch.num_rows else flat.reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, pa.array(weights))], names=["__series", "n", "weights"])

    kind = dict(sums.dtypes)["__series"]
    fitted = materialize(sums.select("__series", "n", "sums").mapInArrow(solve, f"__series {kind}, n bigint, weights array<double>"), "season-weights")
    at = lambda terms: sum((term * F.col("weights")[i] for i, term in enumerate(terms)), F.lit(0.0))
    residual = F.col("__y") - at(terms)
    # A slice lies within one partition, so joining on it gathers no more than a partition holds.
    weighted = materialize(placed.join(fitted.drop("n"), "__series"), "season-fits")
    spread = (
        tagged.join(weighted, ["__series", PART])
        .withColumn("t", F.col(PLACE) + F.col("shift"))
        .groupBy("__series")
        .agg(F.sqrt(F.avg(residual * residual)).alias("spread"))
    )
    ahead = fitted.join(spread, "__series").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = at(_terms(F.col("n") + F.col("step") - 1, F.col("n").cast("double"), period, pairs))
    return ahead.select(F.col("__series").alias("series"), F.col("n").alias("points"), "step", *_band(value, F.col("spread") * BAND, 4))
