"""Profiles that add up: one small state per file and column, from which the profile of any set of files follows.

A state holds what merges exactly (rows, missing cells, numbers, sums of their powers, extremes) and sketches for the
rest: quantiles by KLL, different values by HLL. A table's profile is an aggregate over the states of its files
and reads no data again. Counts, sums and extremes are exact. Ranks of quartiles, and outliers counted by
the fences that follow from them, are off by up to ``RANK_ERROR`` of the numbers, numbers of different values by
about ``DISTINCT_ERROR``; rows that repeat across files are estimated from the different rows, within a file likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import accurate_sum, is_missing
from plumbline.operators.profile import score_expression

KLL_SIZE = 400
#: 2.3 / 400 ** 0.9 for one rank; measured errors of merged sketches stay well below twice that.
RANK_ERROR = 0.02
#: Places at which merged quantiles are read to count values beyond the fences.
GRID = 1_000
HLL_BITS = 14
DISTINCT_ERROR = 0.02
#: The row of a state that is about whole rows.
ROWS = "*"


def _number(column: T.StructField) -> Column | None:
    if isinstance(column.dataType, T.NumericType):
        return F.nanvl(F.col(f"`{column.name}`").cast("double"), F.lit(None).cast("double"))
    return None


def _state(name: str, kind: str, missing: Column, number: Column, distinct: Column) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        F.lit(kind).alias("dtype"),
        F.count("*").alias("rows"),
        missing.alias("missing"),
        F.count(number).alias("numbers"),
        accurate_sum(number).alias("total"),
        accurate_sum(number * number).alias("squares"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
        F.kll_sketch_agg_double(number, KLL_SIZE).alias("quantiles"),
        F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct"),
    )


def profile_states(df: DataFrame, by: list[str]) -> DataFrame:
    """A row per group of ``by`` (a file, a batch) and column, and one for whole rows; one scan and no shuffle but of states."""
    columns = [f for f in df.schema.fields if f.name not in by]
    none = F.lit(None).cast("double")
    whole = F.xxhash64(*[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\0")) for f in columns])
    states = [_state(ROWS, "row", F.lit(0).cast("bigint"), none, whole)]
    for f in columns:
        c, number = F.col(f"`{f.name}`"), _number(f)
        states.append(_state(f.name, f.dataType.simpleString(), F.count_if(is_missing(c, f.dataType)), none if number is None else number, F.xxhash64(c.cast("string"))))
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*[s.alias(f"s{i}") for i, s in enumerate(states)])
    return grouped.select(*[F.col(f"`{c}`") for c in by], F.inline(F.array(*[F.col(f"s{i}") for i in range(len(states))])))


def merged_profile(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The profile of each column over all states (of each group of ``by``): exact numbers, quartiles, fences, outliers, different values."""
    keys = [F.col(f"`{c}`") for c in by or []]
    merged = states.groupBy(*keys, "column", "dtype").agg(
        *[F.sum(c).alias(c) for c in ("rows", "missing", "numbers")],
        *[accurate_sum(F.col(c)).alias(c) for c in ("total", "squares")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("quantiles", KLL_SIZE).alias("quantiles"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("different"),
    )
    n = F.col("numbers")
    known = n > 0
    at = lambda rank: F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(rank)))
    placed = merged.withColumns({"q1": at(0.25), "median": at(0.5), "q3": at(0.75)})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    placed = placed.withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach})
    # Ranks have to be literals: the share beyond a fence is read off a grid of quantiles.
    grid = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    beyond = lambda low, high: F.size(F.filter(F.when(known, grid), lambda q: (q < low) | (q > high))) / GRID
    mean = F.try_divide(F.col("total"), n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - mean * F.col("total"), n - 1)))
    return placed.select(
        *keys,
        "column",
        "dtype",
        "rows",
        "missing",
        "numbers",
        mean.alias("mean"),
        spread.alias("std"),
        "least",
        "q1",
        "median",
        "q3",
        "most",
        "low_fence",
        "high_fence",
        F.when(known, F.round(n * beyond(F.col("low_fence"), F.col("high_fence"))).cast("bigint")).alias("outliers"),
        "different",
    )


def merged_quality(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per group) with the counts behind the quality score, and the score; from ``merged_profile`` alone."""
    keys = [F.col(f"`{c}`") for c in by or []]
    column = F.col("column") != ROWS
    facts = profile.groupBy(*keys).agg(
        F.max(F.when(~column, F.col("rows"))).alias("total_rows"),
        F.coalesce(F.sum(F.when(column, F.col("rows"))), F.lit(0)).alias("total_cells"),
        F.coalesce(F.sum(F.when(column, F.col("missing"))), F.lit(0)).alias("missing_cells"),
        F.max(F.when(~column, F.greatest(F.lit(0).cast("bigint"), F.col("rows") - F.col("different")))).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(column, F.col("outliers"))), F.lit(0)).alias("outlier_cells"),
    )
    return facts.withColumn("quality_score", score_expression())
