"""Straight-line forecasts by least squares, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import parse_number, py_round
from plumbline.operators.row_index import PART, PLACE, row_index, sorted_positions
from plumbline.session import materialize

MIN_POINTS = 3
MAX_HORIZON = 3650
BAND = 1.96
LINEAR, SEASONAL = "sklearn_regression", "prophet"  # fixed names of the two models
FALLBACK_NOTE = "Prophet is not installed; used linear regression instead."


class ForecastError(ValueError):
    """A forecast cannot be made from the given input."""


def target_value(df: DataFrame, target: str) -> Column:
    """The target column as a number, or an error when there is no such column."""
    if target not in df.columns:
        raise ForecastError(f"Column '{target}' not found in dataset")
    c = F.col(f"`{target}`")
    if isinstance(df.schema[target].dataType, T.StringType):
        return parse_number(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def numeric_series(df: DataFrame, target: str, order_by: Sequence[str | Column]) -> DataFrame:
    """Rows ``(t, y)``: the target's numbers by position in the given order."""
    y = target_value(df, target)
    present = df.select(y.alias("__y"), *order_by).filter(F.col("__y").isNotNull())
    return row_index(present, order_by, "__t").select(F.col("__t").alias("t"), F.col("__y").alias("y"))


@dataclass(frozen=True)
class Line:
    points: int
    slope: float
    intercept: float
    mean: float

    def at(self, t: Column) -> Column:
        return t * self.slope + self.intercept


def fit_line(series: DataFrame, target: str = "y") -> Line:
    """Least squares over ``(t, y)`` with t = 0, 1, 2, ...; three numbers reach the driver.

    The sums of the positions follow from their number, only the products need a scan.
    """
    t, y = F.col("t").cast("double"), F.col("y")
    row = series.agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(t * y).alias("sty")).first()
    n = row["n"]
    if n < MIN_POINTS:
        raise ForecastError(f"Column '{target}' has too few numeric points ({n}) to forecast")
    middle, mean = (n - 1) / 2, row["sy"] / n
    slope = (row["sty"] - middle * row["sy"]) / (n * (n * n - 1) / 12)
    return Line(n, slope, mean - slope * middle, mean)


def residual_facts(series: DataFrame, line: Line) -> DataFrame:
    """One row of residual measures, from a second pass over the series."""
    residual = F.col("y") - line.at(F.col("t"))
    return series.agg(
        F.sum(residual * residual).alias("ss_res"),
        F.sum((F.col("y") - F.lit(line.mean)) * (F.col("y") - F.lit(line.mean))).alias("ss_tot"),
        F.avg(F.abs(residual)).alias("mae"),
        F.avg(residual * residual).alias("mse"),
        F.sqrt(F.avg(residual * residual)).alias("spread"),  # residuals of a fit have mean 0
    )


def forecast_metrics(series: DataFrame, line: Line) -> DataFrame:
    """One row ``(points, slope, r2, mae, rmse)``; a constant series divides by 1."""
    facts = residual_facts(series, line)
    total = F.when(F.col("ss_tot") == 0, 1.0).otherwise(F.col("ss_tot"))
    return facts.select(
        F.lit(line.points).cast("bigint").alias("points"),
        py_round(F.lit(line.slope), 6).alias("slope"),
        py_round(1 - F.col("ss_res") / total, 4).alias("r2"),
        py_round(F.col("mae"), 4).alias("mae"),
        py_round(F.sqrt("mse"), 4).alias("rmse"),
    )


def linear_forecast(series: DataFrame, line: Line, horizon: int = 30) -> DataFrame:
    """Rows ``(t, forecast, lower, upper)`` for the next ``horizon`` positions."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ForecastError(f"horizon must be between 1 and {MAX_HORIZON}")
    band = residual_facts(series, line).select((F.col("spread") * BAND).alias("margin"))
    steps = F.sequence(F.lit(line.points), F.lit(line.points + horizon - 1)).cast("array<bigint>")
    ahead = band.select(F.explode(steps).alias("t"), "margin").withColumn("value", line.at(F.col("t")))
    return ahead.select(
        "t",
        py_round(F.col("value"), 6).alias("forecast"),
        py_round(F.col("value") - F.col("margin"), 6).alias("lower"),
        py_round(F.col("value") + F.col("margin"), 6).alias("upper"),
    )




def choose_model(requested: str) -> tuple[str, str | None]:
    """The model that runs without a known period, and a note."""
    return (LINEAR, FALLBACK_NOTE) if requested == SEASONAL else (LINEAR, None)


def forecast(
    df: DataFrame, target: str, order_by: Sequence[str | Column], horizon: int = 30, model: str = LINEAR, period: int | None = None
) -> DataFrame:
    """Forecast rows with the model used and, where it stands in for another, a note.

    The seasonal model needs the ``period`` of the season in rows; it runs where it beats the line on the last rows.
    """
    series = numeric_series(df, target, order_by)
    if model == SEASONAL and period is not None:
        from plumbline.operators.seasonal import forecast_with_season

        return forecast_with_season(series, period, horizon, target)
    used, note = choose_model(model)
    rows = linear_forecast(series, fit_line(series, target), horizon)
    return rows.withColumns({"model_used": F.lit(used), "note": F.lit(note).cast("string")})


def forecast_export(series: DataFrame, line: Line, horizon: int = 30) -> DataFrame:
    """History and forecast as ``(period, type, value, lower, upper)``, labelled from T-n to T+h."""
    n = line.points
    history = series.select(
        F.concat(F.lit("T-"), (F.lit(n) - F.col("t")).cast("string")).alias("period"),
        F.lit("history").alias("type"),
        py_round(F.col("y"), 6).alias("value"),
    )
    ahead = linear_forecast(series, line, horizon).select(
        F.concat(F.lit("T+"), (F.col("t") - n + 1).cast("string")).alias("period"),
        F.lit("forecast").alias("type"),
        F.col("forecast").alias("value"),
        "lower",
        "upper",
    )
    return history.unionByName(ahead, allowMissingColumns=True)


MANY_SCHEMA = "status string, error string, points bigint, slope double, step int, forecast double, lower double, upper double"


def forecast_many(df: DataFrame, key: str, target: str, order_by: Sequence[str], horizon: int = 1) -> DataFrame:
    """Straight-line forecasts of all series: a row per step ahead, one row for a series that fails.

    Keys may differ in size by any factor: rows are range-partitioned by key and order, so
    a large series spans many partitions. Each partition contributes the sums of one key
    slice by local position; slices are then shifted by the rows before them. A second pass
    adds up the residuals of each slice. An unknown target and a missing key give failed rows.
    """
    if not 1 <= horizon <= MAX_HORIZON:
        raise ForecastError(f"horizon must be between 1 and {MAX_HORIZON}")
    k = F.col(f"`{key}`").alias("__series")
    if target not in df.columns:
        failed = df.select(k).distinct().select(F.col("__series").alias("series"), F.lit("failed").alias("status"))
        return failed.withColumns(
            {"error": F.lit(f"Column '{target}' not found in dataset")}
            | {name: F.lit(None).cast(kind) for name, kind in (f.split() for f in MANY_SCHEMA.split(", ")[2:])}
        )
    rows = df.select(k, target_value(df, target).alias("__y"), *order_by)
    numbers = rows.filter(F.col("__series").isNotNull() & F.col("__y").isNotNull())
    # Both passes must see the same slices, so the tagged rows are written.
    tagged = materialize(sorted_positions(numbers, ["__series", *order_by]).select("__series", "__y", PART, PLACE), "series")
    slices = tagged.groupBy("__series", PART).agg(
        F.count("*").alias("n"),
        F.min(PLACE).alias("start"),
        F.sum("__y").alias("sum_y"),
        F.sum(F.col(PLACE).cast("double") * F.col("__y")).alias("sum_py"),
    )
    before = Window.partitionBy("__series").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start"))
    sums = slices.groupBy("__series").agg(
        F.sum("n").alias("points"), F.sum("sum_y").alias("sy"), F.sum(F.col("sum_py") + F.col("shift") * F.col("sum_y")).alias("sty")
    )
    n = F.col("points").cast("double")
    slope = F.try_divide(F.col("sty") - (n - 1) / 2 * F.col("sy"), n * (n * n - 1) / 12)
    lines = sums.select("__series", "points", slope.alias("slope"), (F.col("sy") / n).alias("mean"))
    lines = lines.withColumn("intercept", F.col("mean") - F.col("slope") * (n - 1) / 2)
    # A slice lies within one partition, so joining on it gathers no more than a partition holds.
    fits = slices.select("__series", PART, "shift").join(lines.select("__series", "slope", "intercept"), "__series")
    residual = F.col("__y") - F.col("intercept") - F.col("slope") * (F.col(PLACE) + F.col("shift"))
    squares = (
        tagged.join(fits, ["__series", PART])
        .groupBy("__series", PART)
        .agg(F.sum(residual * residual).alias("ss"))
        .groupBy("__series")
        .agg(F.sum("ss").alias("ss"))
    )
    keys = rows.select("__series").distinct()
    fitted = keys.join(lines, "__series", "left").join(squares, "__series", "left")
    fitted = fitted.withColumn("points", F.coalesce("points", F.lit(0).cast("bigint")))
    ready = F.col("__series").isNotNull() & (F.col("points") >= MIN_POINTS)
    too_few = F.concat(F.lit(f"Column '{target}' has too few numeric points ("), F.col("points").cast("string"), F.lit(") to forecast"))
    error = F.when(F.col("__series").isNull(), F.lit(f"Rows without a value in column '{key}'")).when(~ready, too_few)
    steps = F.when(ready, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(None).cast("int")))
    ahead = fitted.withColumn("step", F.explode(steps))
    value = F.col("intercept") + F.col("slope") * (F.col("points") + F.col("step") - 1)
    margin = BAND * F.sqrt(F.try_divide(F.col("ss"), F.col("points").cast("double")))
    return ahead.select(
        F.col("__series").alias("series"),
        F.when(ready, "done").otherwise("failed").alias("status"),
        error.alias("error"),
        "points",
        F.when(ready, py_round(F.col("slope"), 6)).alias("slope"),
        "step",
        F.when(ready, py_round(value, 4)).alias("forecast"),
        F.when(ready, py_round(value - margin, 4)).alias("lower"),
        F.when(ready, py_round(value + margin, 4)).alias("upper"),
    )
