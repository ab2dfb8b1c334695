"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as a number. The plain cast also takes Java suffixes ('1d', '2f').
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two 26-bit halves


def parse_number(c: Column) -> Column:
    """Text to double, null when it is not a number (NaN counts as missing)."""
    parsed = F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def py_round(value: Column, digits: int = 0) -> Column:
    """Round the binary value half to even, as Python's ``round`` does.

    ``round`` and ``bround`` work on the decimal text of a double, so they treat 2.675
    as a tie although the stored value lies below it. Here the exact error of the scaled
    product decides which side of the tie the value is on.
    """
    x = value.cast("double")
    scale = 10.0**digits
    scaled = x * scale
    on_tie = F.abs(scaled - F.floor(scaled).cast("double")) == 0.5

    top = x * _SPLIT
    high = top - (top - x)
    low = x - high
    wide = scale * _SPLIT
    scale_high = wide - (wide - scale)
    scale_low = scale - scale_high
    error = ((high * scale_high - scaled) + high * scale_low + low * scale_high) + low * scale_low

    rounded = (
        F.when(on_tie & (error < 0), F.floor(scaled).cast("double"))
        .when(on_tie & (error > 0), F.ceil(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )
    # From here on doubles lie further apart than the digits to round to.
    return F.when(F.abs(scaled) >= 2.0**53, x).otherwise(rounded / scale)


def number_text(value: Column) -> Column:
    """Grouped without decimals from 1000 on, else at most two decimals."""
    x = value.cast("double")
    short = F.regexp_replace(F.format_number(x, 2), r"\.?0+$", "")
    return F.when(F.abs(x) >= 1000, F.format_number(x, 0)).otherwise(short)


def compact_text(value: Column) -> Column:
    """At most one decimal and a letter for thousands, e.g. ``1.2K``; a dash for no value."""
    x = value.cast("double")
    shown = F.lit(None).cast("string")
    for power, letter in reversed(list(enumerate(["", "K", "M", "B", "T"]))):
        scaled = F.floor(F.abs(x) / 1000.0**power * 10 + 0.5) / 10.0
        text = F.concat(F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", ""), F.lit(letter))
        shown = text if letter == "T" else F.when(scaled < 1000, text).otherwise(shown)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(sign, shown))


def byte_text(size: Column) -> Column:
    """A size in the largest unit of 1024 that it fills, with at most one decimal."""
    x = size.cast("double")
    shown = F.lit("0 B")
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        scaled = F.floor(x / 1024.0**power * 10 + 0.5) / 10.0
        shown = F.when(x >= 1024.0**power, F.concat(F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", ""), F.lit(f" {unit}"))).otherwise(shown)
    return shown


def signed_text(value: Column, digits: int) -> Column:
    """Fixed decimals with an explicit sign, e.g. ``+3.5``."""
    return F.format_string(f"%+.{digits}f", py_round(value, digits))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed decimals without grouping, e.g. ``3.5``."""
    return F.format_string(f"%.{digits}f", py_round(value, digits))


def accurate_sum(value: Column) -> Column:
    """The sum of doubles, to the last digit and in any order of rows.

    Each value is cut into a whole number, a multiple of 2**-20 and a tiny rest. The first
    two add up without rounding (the whole part up to 2**53), so partial sums of any
    partitioning agree; a plain sum drifts with the order and can miss a rounding tie.
    """
    x = value.cast("double")
    whole = F.rint(x)
    rest = F.when(F.abs(x) < 2.0**52, x - whole).when(x.isNotNull(), 0.0)  # larger doubles are whole
    steps = F.rint(rest * 2.0**20)
    return F.sum(whole) + (F.sum(steps) / 2.0**20 + F.sum(rest - steps / 2.0**20))


def accurate_avg(value: Column) -> Column:
    return F.try_divide(accurate_sum(value), F.count(value).cast("double"))
