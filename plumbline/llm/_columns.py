"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII takes the fast path, on which ``lower`` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def other_columns(df: DataFrame, produced: Iterable[str]) -> list[str]:
    """Names of the input's columns that no result column replaces (names differ by more than case)."""
    taken = {name.lower() for name in produced}
    return [name for name in df.columns if name.lower() not in taken]


def named(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]
