"""Cleaning a table in a fixed order: trim, types, dates, empty rows, duplicates, fill."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import null_if_nan, parse_mixed_date, parse_number, side_by_side, strip_whitespace
from plumbline.operators.coercion import NUMBER_SHARE, parse_counts, text_columns
from plumbline.operators.profile import duplicate_rows, preview, table_size
from plumbline.operators.quantiles import quantiles
from plumbline.session import materialize

CLEAN_DATE_SHARE = 0.8
# The texts that name what was done, here and in ``clean``.
NO_CHANGES = "No changes were necessary"


@dataclass(frozen=True)
class CleaningOptions:
    trim_whitespace: bool = False
    convert_types: bool = False
    normalize_dates: bool = False
    drop_empty_rows: bool = False
    remove_duplicates: bool = False
    fill_missing: bool = False
    fill_strategy: Literal["auto", "mean", "median", "zero"] = "auto"

    @classmethod
    def everything(cls) -> CleaningOptions:
        return cls(True, True, True, True, True, True)


@dataclass
class Cleaned:
    frame: DataFrame
    operations: list[str] = field(default_factory=list)


def trim_whitespace(df: DataFrame) -> DataFrame:
    texts = text_columns(df)
    return df.withColumns({c: strip_whitespace(F.col(f"`{c}`")) for c in texts}) if texts else df


def convertible(df: DataFrame) -> list[str]:
    """Text columns of which at least 80 % of the values are numbers."""
    present, numbers, _ = parse_counts(df, text_columns(df), [])
    return [c for c in numbers if present[c] and numbers[c] >= NUMBER_SHARE * present[c]]


def convert_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = convertible(df) if columns is None else columns
    return df.withColumns({c: parse_number(F.col(f"`{c}`")) for c in names}) if names else df


def convertible_and_datelike(df: DataFrame) -> tuple[list[str], list[str]]:
    """Both kinds from one scan; a column that converts to numbers holds no dates."""
    texts = text_columns(df)
    present, numbers, dates = parse_counts(df, texts, texts)
    to_number = [c for c in texts if present[c] and numbers[c] >= NUMBER_SHARE * present[c]]
    to_date = [c for c in texts if c not in to_number and present[c] and dates[c] >= CLEAN_DATE_SHARE * present[c]]
    return to_number, to_date


def datelike(df: DataFrame) -> list[str]:
    """Text columns of which at least 80 % of the values are dates."""
    present, _, dates = parse_counts(df, [], text_columns(df))
    return [c for c in dates if present[c] and dates[c] >= CLEAN_DATE_SHARE * present[c]]


def normalize_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Dates in any accepted format become ISO text."""
    names = datelike(df) if columns is None else columns
    iso = {c: F.date_format(parse_mixed_date(F.col(f"`{c}`")), "yyyy-MM-dd") for c in names}
    return df.withColumns(iso) if iso else df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def incomplete_columns(df: DataFrame) -> list[str]:
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value per column, the smallest on ties.

    Counts per value are shuffled, so no task holds all values of a column; columns of
    one type share a scan.
    """
    found: dict[str, object] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for names in by_type.values():
        tagged = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names]
        counted = (
            df.select(F.inline(F.array(*tagged)))
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count("*").alias("copies"))
        )
        top = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("copies"), F.col("value"))).alias("value"))
        found.update({r["column"]: r["value"] for r in top.collect()})
    return found


def fill_values(df: DataFrame, strategy: str = "auto") -> dict[str, object]:
    """The replacement for each column with missing values."""
    gaps = incomplete_columns(df)
    numeric = [c for c in gaps if isinstance(df.schema[c].dataType, T.NumericType)]
    other = [c for c in gaps if c not in numeric]
    values: dict[str, object] = {}
    if strategy == "zero":
        values.update({c: 0 for c in numeric})
    elif strategy == "mean" and numeric:
        row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in numeric]).first()
        values.update({c: row[i] for i, c in enumerate(numeric)})
    elif numeric:
        values.update({c: q[0] if q else None for c, q in quantiles(df, numeric, [0.5]).items()})
    common = modes(df, other)
    for c in other:
        blank = "" if isinstance(df.schema[c].dataType, T.StringType) else None
        values[c] = common.get(c, blank)
    return {c: values[c] for c in gaps}


def fill_missing(df: DataFrame, strategy: str = "auto", values: dict[str, object] | None = None) -> DataFrame:
    values = fill_values(df, strategy) if values is None else values
    filled: dict[str, Column] = {}
    for c, value in values.items():
        if value is None:
            continue
        column, dtype = F.col(f"`{c}`"), df.schema[c].dataType
        whole = isinstance(dtype, T.IntegralType)
        if whole and float(value) != int(value):
            column = column.cast("double")  # a mean or median need not be whole
            filled[c] = F.coalesce(column, F.lit(float(value)))
        else:
            filled[c] = F.coalesce(column, F.lit(value).cast(dtype))
    return df.withColumns(filled) if filled else df


def clean(df: DataFrame, options: CleaningOptions, keep: bool = True) -> Cleaned:
    """Apply the chosen steps and list the ones that changed something.

    Rows without duplicates are written to scratch, since later steps and the caller scan them again;
    with ``keep`` false they are not, and removed duplicates are not counted.
    """
    out = null_if_nan(df)
    done: list[str] = []
    if options.trim_whitespace:
        out = trim_whitespace(out)
        done.append("Trimmed whitespace")
    numbers: list[str] = []
    dates: list[str] = []
    if options.convert_types and options.normalize_dates:
        numbers, dates = convertible_and_datelike(out)
    elif options.convert_types:
        numbers = convertible(out)
    elif options.normalize_dates:
        dates = datelike(out)
    out = normalize_dates(convert_types(out, numbers), dates)
    if numbers:
        done.append(f"Converted to numeric: {', '.join(numbers)}")
    if dates:
        done.append(f"Normalized dates: {', '.join(dates)}")
    before = 0
    if options.drop_empty_rows or options.remove_duplicates:
        blank = reduce(Column.__and__, [F.col(f"`{c}`").isNull() for c in out.columns])
        size = out.agg(F.count("*").alias("rows"), F.count_if(blank).alias("empty")).first()
        before = size["rows"]
        if options.drop_empty_rows:
            out = drop_empty_rows(out)
            before -= size["empty"]
            if size["empty"]:
                done.append(f"Removed {size['empty']} empty row(s)")
    if options.remove_duplicates and not keep:
        out = remove_duplicates(out)
    elif options.remove_duplicates:
        # Later steps scan the result several times; the shuffle should run once.
        out = materialize(remove_duplicates(out), "deduplicated")
        after = out.count()
        if before - after:
            done.append(f"Removed {before - after} duplicate row(s)")
    if options.fill_missing:
        values = fill_values(out, options.fill_strategy)
        out = fill_missing(out, options.fill_strategy, values)
        if values:
            done.append(f"Filled missing values in: {', '.join(values)}")
    return Cleaned(out, done or [NO_CHANGES])


def cleaning_summary(before: DataFrame, cleaned: Cleaned) -> DataFrame:
    """One row: rows, missing cells and duplicates before and after, and what was done."""

    def facts(df: DataFrame, suffix: str) -> list[DataFrame]:
        size = table_size(df).select(
            F.col("total_rows").alias(f"rows_{suffix}"), F.col("missing_cells").alias(f"missing_{suffix}")
        )
        return [size, duplicate_rows(df).withColumnRenamed("duplicate_rows", f"duplicates_{suffix}")]

    facts_row = side_by_side(*facts(null_if_nan(before), "before"), *facts(cleaned.frame, "after"))
    return facts_row.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        "missing_before",
        "missing_after",
        "duplicates_before",
        "duplicates_after",
        F.array(*[F.lit(o) for o in cleaned.operations]).alias("operations_applied"),
    )


def cleaning_preview(df: DataFrame, options: CleaningOptions, order_by: list[str], limit: int = 100) -> DataFrame:
    """The first rows of the cleaned table; nothing is kept."""
    return preview(clean(df, options, keep=False).frame, order_by, limit)
