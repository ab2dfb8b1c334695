"""Which columns are measures, dimensions and dates, and which one to use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.distinct import MARGIN, distinct_counts, exact_counts

# Fixed values, searched in this order.
MEASURE_HINTS = [
    "revenue", "sales", "amount", "total", "profit", "price", "cost",
    "value", "quantity", "qty", "count", "spend", "income", "margin",
]
GEO_HINTS = ["region", "country", "state", "city", "province", "location", "territory", "zone", "market"]


def measure_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def dimension_limit(rows: int) -> int:
    """The most distinct values a text column may have to count as a dimension."""
    return max(50, rows // 2 + 1)


def dimension_counts(df: DataFrame) -> dict[str, int]:
    """Dimensions with their distinct counts (estimates where far from any decision)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}

    def doubtful(rows: int, estimate: int) -> bool:
        """Perhaps constant, or close to the limit."""
        return estimate <= 3 or abs(estimate - dimension_limit(rows)) <= MARGIN * estimate

    rows, counts = distinct_counts(df, texts, doubtful)
    return {c: n for c, n in counts.items() if 1 < n <= dimension_limit(rows)}


@dataclass(frozen=True)
class Roles:
    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    dates: tuple[str, ...]
    dimension_sizes: tuple[int, ...] = ()

    @classmethod
    def of(cls, df: DataFrame) -> Roles:
        sizes = dimension_counts(df)
        return cls(tuple(measure_columns(df)), tuple(sizes), tuple(date_columns(df)), tuple(sizes.values()))


def mentioned(question: str, names: Sequence[str]) -> str | None:
    """The longest name found in the question."""
    text = question.lower()
    hits = [n for n in names if n.lower() in text]
    return max(hits, key=len) if hits else None


def hinted_measure(names: Sequence[str]) -> str | None:
    return next((n for hint in MEASURE_HINTS for n in names if hint in n.lower()), None)


def variances(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Sample variances; 0 where undefined."""
    if not names:
        return {}
    row = df.agg(
        *[
            F.when(F.count(F.col(f"`{c}`")) > 1, F.var_samp(F.col(f"`{c}`").cast("double"))).alias(f"v{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    return {c: row[i] or 0.0 for i, c in enumerate(names)}


def pick_measure(df: DataFrame, question: str = "") -> str | None:
    """Mentioned, else hinted by name, else of the highest variance."""
    names = measure_columns(df)
    if not names:
        return None
    named = mentioned(question, names) or hinted_measure(names)
    if named:
        return named
    spread = variances(df, names)
    return max(names, key=spread.__getitem__)


def pick_dimension(df: DataFrame, question: str = "", roles: Roles | None = None) -> str | None:
    """Mentioned, else with the fewest distinct values (the first on ties)."""
    roles = roles or Roles.of(df)
    if not roles.dimensions:
        return None
    named = mentioned(question, roles.dimensions)
    if named:
        return named
    sizes = dict(zip(roles.dimensions, roles.dimension_sizes))
    smallest = min(sizes.values())
    close = {c: n for c, n in sizes.items() if n <= smallest * (1 + 2 * MARGIN) + 1}
    if len(close) > 1:
        sizes = exact_counts(df, close)
    return min(sizes, key=sizes.__getitem__)


def pick_date(df: DataFrame, question: str = "") -> str | None:
    names = date_columns(df)
    return (mentioned(question, names) or names[0]) if names else None


def geo_dimension(dimensions: Sequence[str]) -> str | None:
    return next((c for c in dimensions if any(hint in c.lower() for hint in GEO_HINTS)), None)


def column_roles(df: DataFrame) -> DataFrame:
    """Rows ``(role, ordinal, column)`` for every measure, dimension and date."""
    roles = Roles.of(df)
    rows = [
        (role, i, name)
        for role, names in (("measure", roles.measures), ("dimension", roles.dimensions), ("date", roles.dates))
        for i, name in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, "role string, ordinal int, column string")


def schema_snapshot(df: DataFrame) -> DataFrame:
    """Rows ``(ordinal, name, dtype)``."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, dtype string")


def schema_context(df: DataFrame, name: str) -> DataFrame:
    """One line that names the table and its columns."""
    listed = schema_snapshot(df).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]), ", ").alias("names")
    )
    return listed.select(F.concat(F.lit(f"Dataset '{name}' with columns: "), "names").alias("context"))
