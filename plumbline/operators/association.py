"""Correlations between measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import py_round, to_long
from plumbline.operators.roles import measure_columns

SUMS_PER_PASS = 300  # keeps generated aggregation code within limits on wide tables


@dataclass(frozen=True)
class _Column:
    name: str
    mean: float
    has_gaps: bool
    is_constant: bool

    @property
    def centred(self) -> Column:
        """The distance from the mean, 0 where missing."""
        x = F.col(f"`{self.name}`").cast("double") - F.lit(self.mean)
        return F.coalesce(x, F.lit(0.0)) if self.has_gaps else x

    @property
    def present(self) -> Column | None:
        """1 or 0, ``None`` for a column without gaps."""
        return F.col(f"`{self.name}`").isNotNull().cast("double") if self.has_gaps else None


def _describe(df: DataFrame, names: Sequence[str]) -> dict[str, _Column]:
    """Mean, gaps and constancy of each column, from one scan."""
    aggregates = [F.count("*").alias("n")]
    for i, name in enumerate(names):
        x = F.col(f"`{name}`").cast("double")
        aggregates += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    return {
        name: _Column(name, row[f"mean{i}"] or 0.0, row[f"n{i}"] < row["n"], row[f"lo{i}"] == row[f"hi{i}"])
        for i, name in enumerate(names)
    }


def _times(*factors: Column | None) -> Column | None:
    """The product of the factors that are not ``None`` (a factor of 1)."""
    given = [f for f in factors if f is not None]
    return reduce(lambda x, y: x * y, given) if given else None


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(ordinal, a, b, corr)`` over the rows where both columns have a value.

    The means come first, so that the second scan only adds up products of small centred
    numbers: plain sums generate short code, and sums without gaps are shared by all pairs
    of a column. A pair with a constant side has no correlation.
    """
    columns = _describe(df, sorted({c for pair in pairs for c in pair})) if pairs else {}
    passes, sums, entries = [], {}, []

    def total(product: Column | None, *key: str) -> Column:
        alias = " ".join(key)
        sums[alias] = F.count("*").cast("double") if product is None else F.sum(product)
        return F.col(f"`{alias}`")

    def flush() -> None:
        row = df.agg(F.count("*").alias("all rows"), *[c.alias(name) for name, c in sums.items()])
        passes.append(to_long(row, entries))
        sums.clear()
        entries.clear()

    for i, (left, right) in enumerate(pairs):
        a, b = columns[left], columns[right]
        if a.is_constant or b.is_constant:
            r = F.lit(None).cast("double")
        else:
            x, y, has_x, has_y = a.centred, b.centred, a.present, b.present
            # A name tells which gaps a sum depends on, so equal sums are computed once.
            in_x, in_y = (left if a.has_gaps else ""), (right if b.has_gaps else "")
            n = total(_times(has_x, has_y), "n", *sorted({in_x, in_y}))
            sx, sy = total(_times(x, has_y), "s", left, in_y), total(_times(y, has_x), "s", right, in_x)
            sxx = total(_times(x, x, has_y), "ss", left, in_y)
            syy = total(_times(y, y, has_x), "ss", right, in_x)
            sxy = total(x * y, "sp", *sorted((left, right)))
            vx, vy = _spread(sxx, sx, n), _spread(syy, sy, n)
            r = F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(vx) * F.sqrt(vy))
        entries.append({"ordinal": F.lit(i), "a": F.lit(left), "b": F.lit(right), "corr": r})
        if len(sums) >= SUMS_PER_PASS:
            flush()
    if entries:
        flush()
    if not passes:
        return df.sparkSession.createDataFrame([], "ordinal int, a string, b string, corr double")
    return reduce(DataFrame.unionByName, passes)


def _spread(squares: Column, total: Column, n: Column) -> Column:
    """The centred sum of squares; 0 when it is only the rounding error of equal values."""
    spread = squares - F.try_divide(total * total, n)
    return F.when(spread > squares * 1e-12, spread).otherwise(0.0)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Rows ``(a, b, corr)`` for every ordered pair; none with fewer than two measures."""
    names = list(measure_columns(df) if columns is None else columns)
    if len(names) < 2:
        return pair_correlations(df, []).drop("ordinal")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    upper = pair_correlations(df, pairs).select("a", "b", py_round(F.col("corr"), digits).alias("corr"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "corr"))).otherwise(
        F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    )
    return upper.select(F.inline(both))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "moderate").otherwise("weak")


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def ranked_pairs(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` pairs of the strongest correlation: ``(rank, a, b, corr)``."""
    found = pair_correlations(df, list(combinations(columns, 2))).filter(F.col("corr").isNotNull())
    order = [F.abs("corr").desc(), F.asc("ordinal")]
    top = found.orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "a", "b", "corr")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The strongest pairs: ``(a, b, value, strength, direction)``, in column order on ties."""
    names = list(measure_columns(df) if columns is None else columns)
    found = pair_correlations(df, list(combinations(names, 2))).filter(F.col("corr").isNotNull())
    value = py_round(F.col("corr"), 3)
    return (
        found.withColumn("value", value)
        .orderBy(F.abs("value").desc(), "ordinal")
        .limit(k)
        .select(
            "a",
            "b",
            "value",
            strength(F.col("corr")).alias("strength"),
            direction(F.col("corr")).alias("direction"),
        )
    )


def strongest_driver(df: DataFrame, primary: str) -> DataFrame:
    """One row ``(driver, driver_r)``: the measure most correlated with ``primary``."""
    others = [c for c in measure_columns(df) if c != primary]
    found = pair_correlations(df, [(primary, c) for c in others]).filter(F.col("corr").isNotNull())
    best = F.min_by(F.struct("b", "corr"), F.struct(-F.abs("corr"), F.col("ordinal")))
    return found.agg(best.alias("best")).select(F.col("best.b").alias("driver"), F.col("best.corr").alias("driver_r"))
