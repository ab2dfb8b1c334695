from plumbline.functions.dates import month_end, parse_mixed_date, week_end
from plumbline.functions.frames import side_by_side, to_long
from plumbline.functions.numbers import accurate_avg, accurate_sum, byte_text, compact_text, number_text, parse_number, py_round, signed_text
from plumbline.functions.text import is_missing, null_if_nan, strip_whitespace

__all__ = [
    "accurate_avg",
    "accurate_sum",
    "byte_text",
    "compact_text",
    "is_missing",
    "month_end",
    "null_if_nan",
    "number_text",
    "parse_mixed_date",
    "parse_number",
    "py_round",
    "side_by_side",
    "signed_text",
    "strip_whitespace",
    "to_long",
    "week_end",
]
