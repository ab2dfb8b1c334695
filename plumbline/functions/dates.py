"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date texts, tried in this order (month first, then day first).
# The guard keeps each format away from texts of another shape.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
]
_ISO_TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d"
# Three numbers with one sign between, and a time of day; as parts: numbers, hour, minute, second, half day.
_NUMBERS = r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{4}|\d{1,2})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AP]M))?)?$"
_NUMBER_PARTS = "$1,$3,$4,$5,$6,$7,$8"
# A month's name with a day before or after it, or none; as parts: day before, name, day after, year. Weekdays go.
_NAMED = (
    r"^(?:(?:MON|TUE|TUES|WED|WEDNES|THU|THUR|THURS|FRI|SAT|SATUR|SUN)(?:DAY)?[,.]? +)?"
    r"(?:(\d{1,2})[ ,./-]+)?([A-Z]{3,9})[ ,./-]+(?:(\d{1,2})[ ,./-]+)?(\d{4}|\d{2})$"
)
_NAMED_PARTS = "$1,$2,$3,$4"
_MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()
_LONGEST = 40
#: Years that a timestamp in nanoseconds reaches.
_YEARS = 1678, 2261


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole(part: Column) -> Column:
    return part.try_cast("int")


def _year(part: Column) -> Column:
    """A year of two digits is less than 50 years ahead."""
    short = _whole(part) + 2000
    return F.when(F.char_length(part) == 4, _whole(part)).otherwise(short - F.when(short >= F.year(F.current_date()) + 50, 100).otherwise(0))


def _of_numbers(p: Column) -> Column:
    """Year first, or month first, or else day first."""
    ahead = F.char_length(p[0]) == 4
    first, second = _whole(F.when(ahead, p[1]).otherwise(p[0])), _whole(F.when(ahead, p[2]).otherwise(p[1]))
    swapped = ~ahead & (first > 12)
    hour, half = F.coalesce(_whole(p[3]), F.lit(0)), p[6]
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    fits = F.when(ahead, F.char_length(p[2]) <= 2).otherwise((F.char_length(p[0]) <= 2) & F.char_length(p[2]).isin(2, 4))
    moment = F.try_make_timestamp(
        F.when(ahead, _whole(p[0])).otherwise(_year(p[2])),
        F.when(swapped, second).otherwise(first),
        F.when(swapped, first).otherwise(second),
        hour,
        F.coalesce(_whole(p[4]), F.lit(0)),
        F.coalesce(_whole(p[5]), F.lit(0)).cast("decimal(16,6)"),
    )
    return F.when(fits, moment)


def _of_names(p: Column) -> Column:
    full, short = F.array(*map(F.lit, _MONTHS)), F.array(*[F.lit(m[:3]) for m in _MONTHS])
    month = F.greatest(F.array_position(full, p[1]), F.array_position(short, p[1])).cast("int")
    day = F.when(p[0] == "", p[2]).otherwise(p[0])
    fits = (month > 0) & ((p[0] == "") | (p[2] == "")) & ((day != "") | (F.char_length(p[3]) == 4))
    zero = F.lit(0)
    return F.when(fits, F.try_make_timestamp(_year(p[3]), month, F.coalesce(_whole(day), F.lit(1)), zero, zero, zero.cast("decimal(16,6)")))


def parse_mixed_date(c: Column) -> Column:
    """Text in any accepted format to timestamp, null when no format fits."""
    text = F.trim(c)
    attempts = [F.when(text.rlike(guard), F.try_to_timestamp(text, F.lit(fmt))) for guard, fmt in DATE_FORMATS]
    attempts.append(F.when(text.rlike(_ISO_TIMESTAMP), text.try_cast("timestamp")))
    # Most other texts are not dates: those without a digit and long ones are not tried.
    parts = lambda pattern, to: F.split(F.regexp_replace(F.upper(text), pattern, to), ",")
    other = (
        F.when(F.upper(text).rlike(_NUMBERS), _bound(parts(_NUMBERS, _NUMBER_PARTS), _of_numbers))
        .when(F.upper(text).rlike(_NAMED), _bound(parts(_NAMED, _NAMED_PARTS), _of_names))
        .when(text.rlike(r"^\d{4}$") & text.try_cast("int").between(*_YEARS), F.try_to_timestamp(text, F.lit("yyyy")))
    )
    attempts.append(F.when(text.rlike("[0-9]") & (F.char_length(text) <= _LONGEST), other))
    return F.coalesce(*attempts)


def month_end(c: Column) -> Column:
    return F.last_day(c.cast("date"))


def week_end(c: Column) -> Column:
    """The Sunday on or after the date."""
    return F.next_day(F.date_sub(c.cast("date"), 1), "SU")
