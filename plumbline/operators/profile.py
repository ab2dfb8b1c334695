"""Data-quality and descriptive profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import is_missing, py_round, side_by_side, to_long
from plumbline.operators.distinct import capped_distinct
from plumbline.operators.quantiles import quantiles
from plumbline.operators.roles import measure_columns

MISSING_LABEL = "—"  # fixed value shown for missing categories
NO_ISSUES = "No major data quality issues detected"


def _missing_counts(df: DataFrame) -> list[Column]:
    return [
        F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"missing{i}")
        for i, f in enumerate(df.schema.fields)
    ]


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values: ``(column, missing_count, missing_pct)``."""
    counts = df.agg(F.count("*").alias("n"), *_missing_counts(df))
    share = lambda c: F.when(F.col("n") > 0, c / F.col("n") * 100).otherwise(0.0)
    long = to_long(
        counts,
        [
            {"column": F.lit(name), "missing_count": F.col(f"missing{i}"), "missing_pct": share(F.col(f"missing{i}"))}
            for i, name in enumerate(df.columns)
        ],
        {"missing_pct": 2},
    )
    return long.filter("missing_count > 0")


def table_size(df: DataFrame, *extra: Column) -> DataFrame:
    """One row ``(total_rows, total_cells, missing_cells)`` and extra aggregates, from one scan."""
    width = max(len(df.columns), 1)
    counts = df.agg(F.count("*").alias("total_rows"), *_missing_counts(df), *extra)
    missing = sum((F.col(f"missing{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))
    return counts.withColumns({"total_cells": F.col("total_rows") * width, "missing_cells": missing}).drop(
        *[f"missing{i}" for i in range(len(df.columns))]
    )


def missing_pct() -> Column:
    """Percentage of missing cells, over ``table_size``."""
    return F.when(F.col("total_rows") > 0, F.col("missing_cells") / F.col("total_cells") * 100).otherwise(0.0)


def completeness() -> Column:
    """Percentage of cells with a value, over ``table_size``."""
    pct = py_round(100 - F.col("missing_cells") / F.col("total_cells") * 100, 1)
    return F.when(F.col("total_rows") > 0, pct).otherwise(0.0)


def _row_key(field: T.StructField) -> Column:
    """A grouping key as telling as the value, but short to shuffle for long texts."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    if isinstance(field.dataType, (T.MapType, T.VariantType)):
        return F.to_json(F.struct(c))
    return c


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``(duplicate_rows)``: rows equal to an earlier one in all columns, nulls equal."""
    keys = [_row_key(f).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    copies = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def iqr_bounds(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> dict[str, tuple[float, float]]:
    """Tukey fences per measure; columns without values or without spread are left out."""
    names = list(measure_columns(df) if columns is None else columns)
    fences = {}
    for c, quartiles in quantiles(df, names, [0.25, 0.75], exact).items():
        if quartiles is None:
            continue
        q1, q3 = quartiles
        spread = q3 - q1
        if spread != 0:
            fences[c] = (q1 - 1.5 * spread, q3 + 1.5 * spread)
    return fences


def outside(column: str, fence: tuple[float, float]) -> Column:
    c = F.col(f"`{column}`").cast("double")
    return (c < fence[0]) | (c > fence[1])


def iqr_outliers(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns with outliers: ``(column, outlier_count)``."""
    fences = iqr_bounds(df) if fences is None else fences
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, outlier_count bigint")
    counts = df.agg(*[F.count_if(outside(c, f)).alias(f"o{i}") for i, (c, f) in enumerate(fences.items())])
    long = to_long(counts, [{"column": F.lit(c), "outlier_count": F.col(f"o{i}")} for i, c in enumerate(fences)])
    return long.filter("outlier_count > 0")


def quality_facts(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row with all counts behind the score: one scan, and one shuffle for the duplicates."""
    fences = iqr_bounds(df) if fences is None else fences
    outliers = sum((F.count_if(outside(c, f)) for c, f in fences.items()), F.lit(0).cast("bigint"))
    return side_by_side(table_size(df, outliers.alias("outlier_cells")), duplicate_rows(df))


def quality_score(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row ``(quality_score)`` from 0 to 100."""
    return quality_facts(df, fences).select(score_expression().alias("quality_score"))


def score_expression() -> Column:
    """The score over ``total_rows, total_cells, missing_cells, duplicate_rows, outlier_cells``.

    Fixed weights: 40 for missing cells, 35 for duplicate rows, and 25 for outlier cells,
    where only the outlier term is scaled by 100.
    """
    raw = (
        F.lit(100.0)
        - F.col("missing_cells") / F.col("total_cells") * 40
        - F.col("duplicate_rows") / F.col("total_rows") * 35
        - F.col("outlier_cells") / F.col("total_cells") * 25 * 100
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(raw)))
    return F.when(F.col("total_rows") > 0, bounded).otherwise(0).cast("int")


def _names_where(counts: dict[str, str]) -> Column:
    """The names of the columns whose count is above 0, in table order."""
    named = [F.when(F.col(count) > 0, F.lit(name)) for name, count in counts.items()]
    return F.filter(F.array(*named), lambda c: c.isNotNull()) if named else F.array().cast("array<string>")


def quality_report(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row with row count, duplicates, affected columns and suggestions."""
    fences = iqr_bounds(df) if fences is None else fences
    counts = df.agg(
        F.count("*").alias("total_rows"),
        *_missing_counts(df),
        *[F.count_if(outside(c, f)).alias(f"outliers{i}") for i, (c, f) in enumerate(fences.items())],
    ).select(
        "total_rows",
        _names_where({c: f"missing{i}" for i, c in enumerate(df.columns)}).alias("missing_columns"),
        _names_where({c: f"outliers{i}" for i, c in enumerate(fences)}).alias("outlier_columns"),
    )
    parts = side_by_side(counts, duplicate_rows(df))
    found = F.filter(
        F.array(
            F.when(
                F.size("missing_columns") > 0,
                F.concat(F.lit("Impute or drop missing values in: "), F.array_join("missing_columns", ", ")),
            ),
            F.when(F.col("duplicate_rows") > 0, F.format_string("Remove %d duplicate row(s)", "duplicate_rows")),
            F.when(
                F.size("outlier_columns") > 0,
                F.concat(F.lit("Review outliers detected via IQR in: "), F.array_join("outlier_columns", ", ")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return parts.withColumn("suggestions", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_ISSUES))))


def quality_suggestions(df: DataFrame) -> DataFrame:
    """Rows ``(ordinal, suggestion)``."""
    return quality_report(df).select(F.posexplode("suggestions").alias("ordinal", "suggestion"))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of every measure with values."""
    names = list(measure_columns(df) if columns is None else columns)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, mean double, std double, min double, q25 double, median double, q75 double, max double"
        )
    cuts = quantiles(df, names, [0.25, 0.5, 0.75], exact)
    names = [c for c in names if cuts[c] is not None]
    aggregates = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
    entries = []
    for i, c in enumerate(names):
        q25, median, q75 = (F.lit(v) for v in cuts[c])
        spread = F.when(F.col(f"n{i}") > 1, F.col(f"std{i}")).otherwise(0.0)
        numbers = {
            "mean": F.col(f"mean{i}"), "std": spread, "min": F.col(f"min{i}"),
            "q25": q25, "median": median, "q75": q75, "max": F.col(f"max{i}"),
        }
        entries.append({"column": F.lit(c), "count": F.col(f"n{i}")} | numbers)
    return to_long(df.agg(F.count("*"), *aggregates), entries, dict.fromkeys(numbers, 4))


def histogram_edges(
    df: DataFrame, columns: Sequence[str], most: int = 10, least: int = 1
) -> dict[str, list[float]]:
    """Equal-width edges; the number of bins follows the distinct count within limits."""
    if not columns:
        return {}
    distinct = capped_distinct(df, columns)
    ends = df.agg(
        *[e for i, c in enumerate(columns) for e in (F.min(F.col(f"`{c}`").cast("double")).alias(f"lo{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"hi{i}"))]
    ).first()
    edges = {}
    for i, c in enumerate(columns):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        bins = min(most, max(least, distinct[c]))
        edges[c] = [float(e) for e in np.linspace(low, high, bins + 1)]
    return edges


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, most: int = 10, least: int = 1
) -> DataFrame:
    """Rows ``(column, bin, start, end, count)``, empty bins included."""
    names = list(measure_columns(df) if columns is None else columns)
    edges = histogram_edges(df, names, most, least)
    spine = df.sparkSession.createDataFrame(
        [(c, b, e[b], e[b + 1]) for c, e in edges.items() for b in range(len(e) - 1)],
        "column string, bin int, start double, end double",
    )
    if not edges:
        return spine.withColumn("count", F.lit(0).cast("bigint"))
    tagged = []
    for c, e in edges.items():
        x = F.col(f"`{c}`").cast("double")
        place = sum(((x >= F.lit(inner)).cast("int") for inner in e[1:-1]), F.lit(0))
        tagged.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), place).alias("bin")))
    counted = (
        df.select(F.inline(F.array(*tagged)))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    return spine.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        py_round(F.col("start"), 3).alias("start"),
        py_round(F.col("end"), 3).alias("end"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def category_distribution(df: DataFrame, columns: Sequence[str] | None = None, k: int = 8) -> DataFrame:
    """The ``k`` most frequent values of every non-numeric column, missing ones labelled."""
    measures = set(measure_columns(df))
    names = [c for c in (df.columns if columns is None else columns) if c not in measures]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    tagged = [
        F.struct(F.lit(c).alias("column"), F.coalesce(_as_text(df, c), F.lit(MISSING_LABEL)).alias("value")) for c in names
    ]
    counted = df.select(F.inline(F.array(*tagged))).groupBy("column", "value").agg(F.count("*").alias("count"))
    first = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        counted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).select("column", "value", "count")
    )


def _as_text(df: DataFrame, name: str) -> Column:
    c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def preview(df: DataFrame, order_by: Sequence[str | Column], limit: int = 50) -> DataFrame:
    """The first rows in the given order (a sorted limit, never a full sort)."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return df.orderBy(*order_by).limit(limit)


def preview_size(df: DataFrame, limit: int = 50) -> DataFrame:
    """One row ``(total_rows, previewed_rows)``."""
    return df.agg(F.count("*").alias("total_rows")).withColumn(
        "previewed_rows", F.least("total_rows", F.lit(limit).cast("bigint"))
    )
