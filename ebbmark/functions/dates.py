"""Date reading and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats read, in the order tried (month-first before day-first), by the
# shape of text they fit. The shape is tested first because a format that does not fit is costly.
DATE_PATTERNS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a")),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ("M/d/yy", "d/M/yy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}", ("M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}", ("M.d.yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]")),
    (r"^\d{4}/\d", ("yyyy/M/d[ H:mm[:ss]]",)),
    (r"^\d{4}\.\d", ("yyyy.M.d[ H:mm[:ss]]",)),
    (r"^\d{4}-\d{1,2}$", ("yyyy-M",)),
    (r"^\d{4}-\d{1,2}-\d{1,2} .*[AaPp][Mm]$", ("yyyy-M-d h:mm[:ss] a",)),
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{8}T\d{6}$", ("yyyyMMdd'T'HHmmss",)),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}", ("d-MMM-yyyy[ H:mm[:ss]]",)),
    (r"^[A-Za-z]{3} ", ("MMM d[,] yyyy[ H:mm[:ss]]",)),
    (r"^[A-Za-z]{4,9} ", ("MMMM d[,] yyyy",)),
    (r"^\d{1,2} [A-Za-z]{3} ", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{4,9} ", ("d MMMM yyyy",)),
)
_SHORT_YEAR = r"^\d{1,2}/\d{1,2}/\d{2}$"
_ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
MICROS_PER_DAY = 86_400_000_000


def floor_div(value: Column, unit: int) -> Column:
    """Whole-number division rounded down, without a detour through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit))


def parse_timestamp(text: Column) -> Column:
    """Read each value by the first format that fits; a value no format fits is NULL."""
    trimmed = F.trim(text)
    # The plain cast also reads a bare time as today's; only ISO dates may reach it.
    attempts = [F.when(text.rlike(_ISO_SHAPE), text.try_cast("timestamp"))]
    for shape, patterns in DATE_PATTERNS:
        parsed = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(p)) for p in patterns])
        if shape == _SHORT_YEAR:  # years 69 to 99 are of the last century
            parsed = F.when(F.year(parsed) >= 2069, F.timestamp_add("YEAR", F.lit(-100), parsed)).otherwise(parsed)
        attempts.append(F.when(trimmed.rlike(shape), parsed))
    return F.coalesce(*attempts)


def standard_date(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd")


def month_start(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-01")


def month_after(month: Column, steps: Column) -> Column:
    """The ``YYYY-MM-01`` label ``steps`` months after the label ``month``."""
    return F.date_format(F.add_months(F.to_date(month), steps), "yyyy-MM-01")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down: two hours over midnight are 0 days."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return floor_div(micros, MICROS_PER_DAY)
