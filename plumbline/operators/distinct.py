"""Distinct counts that stay cheap on wide and large tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_ERROR = 0.02
MARGIN = 0.15  # over seven standard deviations of the sketch
FEW = 200


def sketch_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and approximate distinct counts, one scan and no shuffle of values."""
    row = df.agg(
        F.count("*").alias("n"),
        *[F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    return row["n"], {c: row[f"d{i}"] for i, c in enumerate(columns)}


def few_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact counts in one scan, for columns a sketch has shown to hold few values."""
    if not columns:
        return {}
    row = df.agg(*[F.size(F.collect_set(F.col(f"`{c}`"))).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def exact_distinct(df: DataFrame, column: str) -> int:
    """One shuffle of the column's distinct values."""
    return df.agg(F.countDistinct(F.col(f"`{column}`"))).first()[0]


def distinct_counts(
    df: DataFrame,
    columns: Sequence[str],
    matters: Callable[[int, int], bool] = lambda rows, estimate: True,
) -> tuple[int, dict[str, int]]:
    """Row count and distinct counts, exact wherever ``matters`` says so.

    ``matters(rows, estimate)`` tells whether the caller's decision could turn on the
    difference between the estimate and the true count.
    """
    if not columns:
        return df.count(), {}
    rows, counts = sketch_counts(df, columns)
    doubtful = [c for c in columns if matters(rows, counts[c])]
    return rows, counts | exact_counts(df, {c: counts[c] for c in doubtful})


def exact_counts(df: DataFrame, estimates: dict[str, int]) -> dict[str, int]:
    """Exact counts: one scan for all columns of few values, one shuffle for each other."""
    few = [c for c, n in estimates.items() if n <= FEW]
    counts = few_distinct(df, few)
    return {c: counts[c] if c in counts else exact_distinct(df, c) for c in estimates}


def capped_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct counts that are exact up to ``FEW`` and merely large beyond it."""
    return distinct_counts(df, columns, lambda rows, estimate: estimate <= FEW)[1]
