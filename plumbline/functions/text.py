"""Text and missing-value column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip_whitespace(c: Column) -> Column:
    """Remove any white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, _EDGES, "")


def is_missing(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_if_nan(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes null."""
    floating = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df
