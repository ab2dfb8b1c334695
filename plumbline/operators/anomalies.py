"""Outliers per measure, with severity, extremes and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import number_text, py_round, to_long
from plumbline.operators.profile import iqr_bounds, outside
from plumbline.operators.row_index import row_index

NO_ANOMALIES = "No statistical anomalies detected — the numeric data is consistent."
Fences = dict[str, tuple[float, float]]


def severity(ratio: Column) -> Column:
    return F.when(ratio > 0.1, "high").when(ratio > 0.03, "medium").otherwise("low")


def anomaly_items(df: DataFrame, fences: Fences | None = None) -> DataFrame:
    """One row per measure with outliers, the most affected first in ``rank``."""
    fences = iqr_bounds(df) if fences is None else fences
    if not fences:
        return df.sparkSession.createDataFrame(
            [],
            "rank int, column string, count bigint, pct double, severity string, lower_bound double, "
            "upper_bound double, extremes array<double>, root_cause string",
        )
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(outside(c, f)).alias(f"o{i}") for i, (c, f) in enumerate(fences.items())]
    )
    found = to_long(
        counts,
        [
            {
                "ordinal": F.lit(i),
                "column": F.lit(c),
                "count": F.col(f"o{i}"),
                "ratio": F.col(f"o{i}") / F.col("n"),
                "low": F.lit(low),
                "high": F.lit(high),
            }
            for i, (c, (low, high)) in enumerate(fences.items())
        ],
    ).filter("count > 0")
    by_count = Window.orderBy(F.desc("count"), "ordinal")  # one row per column of the table
    cause = F.concat(
        F.col("count").cast("string"),
        F.lit(" value(s) fall outside the expected range ["),
        number_text(F.col("low")),
        F.lit(", "),
        number_text(F.col("high")),
        F.lit("]."),
    )
    return found.join(_extremes(df, fences), "column", "left").select(
        F.row_number().over(by_count).alias("rank"),
        "column",
        "count",
        py_round(F.col("ratio") * 100, 1).alias("pct"),
        severity(F.col("ratio")).alias("severity"),
        py_round(F.col("low"), 2).alias("lower_bound"),
        py_round(F.col("high"), 2).alias("upper_bound"),
        "extremes",
        cause.alias("root_cause"),
    )


def _extremes(df: DataFrame, fences: Fences, k: int = 3) -> DataFrame:
    """The ``k`` largest absolute outliers per column; each task forwards only its own ``k``."""
    tagged = [
        F.struct(F.lit(c).alias("column"), F.when(outside(c, f), F.abs(F.col(f"`{c}`").cast("double"))).alias("size"))
        for c, f in fences.items()
    ]
    largest = Window.partitionBy("column").orderBy(F.desc("size"))
    top = (
        df.select(F.inline(F.array(*tagged)))
        .filter(F.col("size").isNotNull())
        .withColumn("place", F.row_number().over(largest))
        .filter(F.col("place") <= k)
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "size"))), lambda s: py_round(s["size"], 2))
    return top.groupBy("column").agg(listed.alias("extremes"))


def anomaly_recommendations(items: DataFrame, k: int = 3) -> DataFrame:
    """Rows ``(ordinal, recommendation)`` for the first items, or one all-clear line."""
    high = F.concat(
        F.lit("Investigate **"),
        F.col("column"),
        F.lit("** — "),
        F.format_string("%.1f", "pct"),
        F.lit("% of values are outliers; check for data-entry or process issues."),
    )
    other = F.concat(
        F.lit("Review **"),
        F.col("column"),
        F.lit("** outliers before aggregating; consider capping or excluding extreme values."),
    )
    text = F.when(F.col("severity") == "high", high).otherwise(other)
    lines = F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("ordinal"), text.alias("recommendation"))))
    all_clear = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(NO_ANOMALIES).alias("recommendation")))
    gathered = items.filter(F.col("rank") <= k).agg(lines.alias("lines"))
    return gathered.select(F.inline(F.when(F.size("lines") > 0, F.col("lines")).otherwise(all_clear)))


def anomaly_totals(items: DataFrame) -> DataFrame:
    """One row ``(outliers, columns_affected)``."""
    return items.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("outliers"), F.count("*").alias("columns_affected")
    )


def worst_column(df: DataFrame, fences: Fences) -> str | None:
    """The measure with the most outliers, the first on ties."""
    if not fences:
        return None
    counts = df.agg(*[F.count_if(outside(c, f)) for c, f in fences.items()]).first()
    best = max(range(len(fences)), key=lambda i: counts[i])
    return list(fences)[best] if counts[best] else None


def anomaly_points(df: DataFrame, order_by: Sequence[str | Column], fences: Fences | None = None) -> DataFrame:
    """Rows ``(t, value, is_outlier)`` of the worst column, by position among its values."""
    fences = iqr_bounds(df) if fences is None else fences
    worst = worst_column(df, fences)
    if worst is None:
        return df.sparkSession.createDataFrame([], "t bigint, value double, is_outlier boolean")
    c = F.col(f"`{worst}`")
    present = df.filter(c.isNotNull()).select(c.cast("double").alias("__value"), *order_by)
    indexed = row_index(present, order_by, "__t")
    return indexed.select(
        F.col("__t").alias("t"), py_round(F.col("__value"), 2).alias("value"), outside("__value", fences[worst]).alias("is_outlier")
    )
