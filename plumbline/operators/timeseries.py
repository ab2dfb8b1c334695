"""Sums per month, week or day, with gaps filled."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import month_end, py_round, week_end
from plumbline.operators.breakdown import total_or_zero

Frequency = Literal["month", "week", "day"]

_BUCKET = {"month": month_end, "week": week_end, "day": lambda c: c.cast("date")}


def _steps(start: Column, following: Column, frequency: Frequency) -> Column:
    """The buckets from ``start`` up to, not including, ``following``."""
    if frequency == "day":
        return F.sequence(start, F.date_sub(following, 1))
    if frequency == "week":
        return F.sequence(start, F.date_sub(following, 7), F.expr("interval 7 days"))
    months = F.sequence(F.trunc(start, "MM"), F.add_months(F.trunc(following, "MM"), -1), F.expr("interval 1 month"))
    return F.transform(months, F.last_day)


def trend(
    df: DataFrame, date: str, measure: str, frequency: Frequency = "month", min_buckets: int = 2
) -> DataFrame:
    """Rows ``(bucket, value)`` from the first to the last bucket, 0 where no row falls.

    Only one scan and one grouped sum: gaps are filled from each bucket to the next one,
    over the grouped rows, so there is no join with a calendar.
    """
    d, m = F.col(f"`{date}`"), F.col(f"`{measure}`")
    sums = (
        df.filter(d.isNotNull() & m.isNotNull())
        .groupBy(_BUCKET[frequency](d).alias("bucket"))
        .agg(total_or_zero(measure).alias("value"))
    )
    # One row per calendar bucket from here on, so a window without keys stays small.
    following = F.lead("bucket").over(Window.orderBy("bucket"))
    spans = sums.withColumn("following", following)
    steps = F.when(F.col("following").isNull(), F.array("bucket")).otherwise(
        _steps(F.col("bucket"), F.col("following"), frequency)
    )
    filled = spans.select(F.posexplode(steps).alias("gap", "bucket"), F.col("value").alias("total"))
    value = F.when(F.col("gap") == 0, F.col("total")).otherwise(0.0)
    counted = filled.select("bucket", value.alias("value"), F.count("*").over(Window.partitionBy()).alias("buckets"))
    return counted.filter(F.col("buckets") >= min_buckets).select("bucket", "value")


def trend_window(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The buckets between two dates, both included, either one open."""
    out = series
    if start:
        out = out.filter(F.col("bucket") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("bucket") <= F.lit(end).cast("date"))
    return out


def change_pct(first: Column, last: Column) -> Column:
    return F.when(first == 0, 0.0).otherwise((last - first) / F.abs(first) * 100)


def trend_ends(series: DataFrame) -> DataFrame:
    """One row with buckets, first, last, peak and low; the first extreme counts."""
    peak = F.min_by(F.struct("bucket", "value"), F.struct(-F.col("value"), F.col("bucket")))
    low = F.min_by(F.struct("bucket", "value"), F.struct("value", "bucket"))
    return series.agg(
        F.count("*").alias("buckets"),
        F.min_by("value", "bucket").alias("first"),
        F.max_by("value", "bucket").alias("last"),
        peak.alias("peak"),
        low.alias("low"),
    ).filter("buckets > 0")


def trend_facts(series: DataFrame) -> DataFrame:
    """One row with change, direction, peak and low of a trend; none for an empty one."""
    ends = trend_ends(series).withColumn("change", change_pct(F.col("first"), F.col("last")))
    direction = F.when(F.col("change") > 1, "up").when(F.col("change") < -1, "down").otherwise("flat")
    return ends.select(
        py_round(F.col("first"), 2).alias("first"),
        py_round(F.col("last"), 2).alias("last"),
        py_round(F.col("change"), 1).alias("change_pct"),
        direction.alias("direction"),
        F.col("peak.bucket").alias("peak_date"),
        py_round(F.col("peak.value"), 2).alias("peak_value"),
        F.col("low.bucket").alias("low_date"),
        py_round(F.col("low.value"), 2).alias("low_value"),
    )
