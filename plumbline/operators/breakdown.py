"""Totals per group, shares, key figures and segments.

Grouped sums are partial sums first, so a group that holds much of the table costs no
more than any other; only one row per group and map task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import accurate_avg, accurate_sum, py_round, to_long
from plumbline.operators.distinct import capped_distinct
from plumbline.operators.profile import completeness, quality_facts, score_expression
from plumbline.operators.quantiles import quantiles
from plumbline.operators.roles import Roles, geo_dimension, measure_columns, pick_dimension, pick_measure, variances
from plumbline.session import materialize

SEGMENTS = ["Low", "Medium", "High", "Top"]


def total_or_zero(column: str) -> Column:
    """The sum of a measure; a group without values has the sum 0."""
    return F.coalesce(accurate_sum(F.col(f"`{column}`")), F.lit(0.0))


def grouped_totals(df: DataFrame, dimension: str, measure: str | None) -> DataFrame:
    """Rows ``(name, value)``: the measure's sum, or the row count without a measure."""
    value = total_or_zero(measure) if measure else F.count("*").cast("double")
    key = F.col(f"`{dimension}`")
    return df.filter(key.isNotNull()).groupBy(key.cast("string").alias("name")).agg(value.alias("value"))


def top_groups(totals: DataFrame, k: int, lowest: bool = False) -> DataFrame:
    """The ``k`` first groups by value, names ascending on ties."""
    order = F.asc("value") if lowest else F.desc("value")
    return totals.orderBy(order, F.asc("name")).limit(k)


def share_of_shown(shown: DataFrame) -> DataFrame:
    """Adds ``pct``, the share of the groups shown (a frame already limited to a few rows)."""
    total = F.sum("value").over(Window.partitionBy())
    pct = F.col("value") / F.when(total == 0, 1.0).otherwise(total) * 100
    return shown.withColumn("pct", pct)


def category_breakdown(
    df: DataFrame, measure: str | None = None, dimension: str | None = None, k: int = 10
) -> DataFrame:
    """Rows ``(name, value, pct)`` of the largest groups. Names that are no valid role are ignored."""
    roles = Roles.of(df)
    measure = measure if measure in roles.measures else pick_measure(df)
    dimension = dimension if dimension in roles.dimensions else pick_dimension(df, roles=roles)
    if dimension is None:
        return df.sparkSession.createDataFrame([], "name string, value double, pct double")
    return breakdown(df, dimension, measure, k)


def breakdown(df: DataFrame, dimension: str, measure: str | None, k: int = 10) -> DataFrame:
    shown = share_of_shown(top_groups(grouped_totals(df, dimension, measure), k))
    return shown.select("name", py_round(F.col("value"), 2).alias("value"), py_round(F.col("pct"), 1).alias("pct"))


def pie_slice(rows: DataFrame, k: int = 6) -> DataFrame:
    return top_groups(rows.select("name", "value"), k)


def geo_breakdown(df: DataFrame, measure: str | None = None, k: int = 12) -> DataFrame:
    """Totals by the first dimension whose name suggests a place."""
    roles = Roles.of(df)
    place = geo_dimension(roles.dimensions)
    if place is None:
        return df.sparkSession.createDataFrame([], "name string, value double")
    measure = measure if measure in roles.measures else pick_measure(df)
    shown = top_groups(grouped_totals(df, place, measure), k)
    return shown.select("name", py_round(F.col("value"), 2).alias("value"))


def segmentation(df: DataFrame, measure: str, exact: bool = True) -> DataFrame:
    """Records per quartile of the measure; no rows when quartile edges collide.

    The measure is written once: quantiles, distinct values and counts read it again, not the joins that it may come from."""
    df = materialize(df.select(F.col(f"`{measure}`")), "segmentation")
    empty = df.sparkSession.createDataFrame([], "segment string, records bigint")
    cuts = quantiles(df, [measure], [0.0, 0.25, 0.5, 0.75, 1.0], exact)[measure]
    # pandas-style labels need four segments (five edges) and four different values.
    if cuts is None or len(set(cuts)) < 5 or capped_distinct(df, [measure])[measure] < 4:
        return empty
    x = F.col(f"`{measure}`").cast("double")
    counts = df.agg(
        F.count_if(x <= cuts[1]).alias("s0"),
        *[F.count_if((x > cuts[i]) & (x <= cuts[i + 1])).alias(f"s{i}") for i in (1, 2)],
        F.count_if(x > cuts[3]).alias("s3"),
    )
    return to_long(counts, [{"segment": F.lit(s), "records": F.col(f"s{i}")} for i, s in enumerate(SEGMENTS)])


def ranked_measures(df: DataFrame, k: int = 4) -> list[str]:
    """The ``k`` measures of the highest variance, in column order on ties."""
    names = measure_columns(df)
    spread = variances(df, names)
    return sorted(names, key=lambda c: -spread[c])[:k]


def kpi_measures(df: DataFrame, primary: str | None = None, k: int = 4) -> DataFrame:
    """Total, mean and extremes of the most varying measures."""
    primary = primary or pick_measure(df)
    names = ranked_measures(df, k)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "name string, total double, mean double, min double, max double, is_primary boolean"
        )
    aggregates = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        aggregates += [f(x).alias(f"{n}{i}") for n, f in (("total", accurate_sum), ("mean", accurate_avg), ("min", F.min), ("max", F.max))]
    entries = [
        {"name": F.lit(c)}
        | {n: F.col(f"{n}{i}") for n in ("total", "mean", "min", "max")}
        | {"is_primary": F.lit(c == primary)}
        for i, c in enumerate(names)
    ]
    figures = to_long(df.agg(*aggregates), entries, dict.fromkeys(("total", "mean", "min", "max"), 2))
    return figures.filter(F.col("total").isNotNull())


def kpi_summary(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row: row, column and measure counts, quality score and completeness."""
    return quality_facts(df, fences).select(
        F.col("total_rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        score_expression().alias("quality_score"),
        completeness().alias("completeness"),
        F.lit(len(measure_columns(df))).alias("numeric_count"),
    )


def scalar_aggregate(df: DataFrame, measure: str, operation: str) -> DataFrame:
    """One row ``(operation, value, records)`` over the non-null values."""
    return scalar_aggregates(df, measure, [operation])


def scalar_aggregates(df: DataFrame, measure: str, operations: Sequence[str]) -> DataFrame:
    """Rows ``(operation, value, records)`` over the non-null values, from one scan."""
    x = F.col(f"`{measure}`").cast("double")
    calculate = {
        "average": accurate_avg(x),
        "count": F.count(x).cast("double"),
        "maximum": F.max(x),
        "minimum": F.min(x),
        "total": accurate_sum(x),
    }
    facts = df.agg(F.count(x).alias("records"), *[calculate[o].alias(f"v{i}") for i, o in enumerate(operations)])
    rows = [F.struct(F.lit(o).alias("operation"), F.col(f"v{i}").alias("value"), F.col("records")) for i, o in enumerate(operations)]
    return facts.select(F.inline(F.array(*rows)))


def group_extremes(totals: DataFrame) -> DataFrame:
    """One row with the leading and last group, the number of groups and the whole total."""
    order = F.struct(-F.col("value"), F.col("name"))
    return totals.agg(
        F.min_by(F.struct("name", "value"), order).alias("leader"),
        F.max_by("name", order).alias("laggard"),
        F.count("*").alias("groups"),
        F.sum("value").alias("all_groups"),
    ).select(
        F.col("leader.name").alias("leader"),
        F.col("leader.value").alias("leader_value"),
        "laggard",
        "groups",
        F.when(F.col("all_groups") == 0, 1.0).otherwise(F.col("all_groups")).alias("all_groups"),
    )

