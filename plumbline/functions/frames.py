"""Small reshaping helpers for aggregated frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import py_round


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames next to each other, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    names = [name for frame in frames for name in frame.columns]
    return stacked.agg(*[F.first(F.col(f"`{n}`"), ignorenulls=True).alias(n) for n in names])


def to_long(
    one_row: DataFrame, entries: Sequence[dict[str, Column]], digits: Mapping[str, int] | None = None
) -> DataFrame:
    """Turn a one-row wide aggregate into one row per entry, then round the named columns.

    Rounding comes last: one expression per column instead of one per entry and column.
    """
    rows = F.array(*[F.struct(*[c.alias(name) for name, c in entry.items()]) for entry in entries])
    long = one_row.select(F.inline(rows))
    return long.withColumns({c: py_round(F.col(c), n) for c, n in digits.items()}) if digits else long
