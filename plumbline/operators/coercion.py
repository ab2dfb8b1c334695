"""Turning text columns into numbers and dates before analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import null_if_nan, parse_mixed_date, parse_number

# Column names that suggest a date.
DATE_HINTS = ["date", "time", "month", "day", "year", "week", "period", "timestamp"]

NUMBER_SHARE = 0.8
DATE_SHARE = 0.6


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def hints_date(name: str) -> bool:
    return any(hint in name.lower() for hint in DATE_HINTS)


def parse_counts(df: DataFrame, numbers: list[str], dates: list[str]) -> tuple[dict, dict, dict]:
    """Non-null, number and date counts for text columns, all from one scan."""
    names = sorted({*numbers, *dates}, key=df.columns.index)
    if not names:
        return {}, {}, {}
    measures = [F.count(F.col(f"`{c}`")).alias(f"present{i}") for i, c in enumerate(names)]
    measures += [F.count(parse_number(F.col(f"`{c}`"))).alias(f"number{names.index(c)}") for c in numbers]
    measures += [F.count(parse_mixed_date(F.col(f"`{c}`"))).alias(f"date{names.index(c)}") for c in dates]
    row = df.agg(*measures).first()
    return (
        {c: row[f"present{i}"] for i, c in enumerate(names)},
        {c: row[f"number{names.index(c)}"] for c in numbers},
        {c: row[f"date{names.index(c)}"] for c in dates},
    )


def coercion_plan(df: DataFrame) -> dict[str, str]:
    """Text columns to convert, as ``{column: 'number' | 'date'}``."""
    texts = text_columns(df)
    present, numbers, dates = parse_counts(df, texts, [c for c in texts if hints_date(c)])
    plan = {}
    for c in texts:
        if present[c] == 0:
            continue
        if numbers[c] >= NUMBER_SHARE * present[c]:
            plan[c] = "number"
        elif c in dates and dates[c] >= DATE_SHARE * present[c]:
            plan[c] = "date"
    return plan


def prepare(df: DataFrame) -> DataFrame:
    """The table as analysed: NaN as null, number-like and date-like text converted."""
    plan = coercion_plan(df)
    converted = {
        c: parse_number(F.col(f"`{c}`")) if kind == "number" else parse_mixed_date(F.col(f"`{c}`"))
        for c, kind in plan.items()
    }
    out = df.withColumns(converted) if converted else df
    return null_if_nan(out)
