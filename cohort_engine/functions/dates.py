"""Dates, and month / quarter numbers counted from January 1960.

Periods are plain integers, so that event time and period arithmetic are integer
subtraction; the label functions turn them back into text.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from .missing import ColumnLike, as_column

EPOCH_YEAR = 1960

DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd",
)
DMY_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "dMMMyyyy")
DAY_MONTH_NAME_FORMAT = "ddMMMyyyy HH:mm:ss"


def parse_datetime(col: ColumnLike, formats: tuple[str, ...] = DATETIME_FORMATS) -> Column:
    """Year-first date-time text to a timestamp without zone; unreadable text is null."""
    text = F.trim(as_column(col))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return parsed.cast("timestamp_ntz")


def parse_date(col: ColumnLike, fmt: str = DAY_MONTH_NAME_FORMAT) -> Column:
    return F.try_to_date(F.trim(as_column(col)), fmt)


def parse_date_prefix(col: ColumnLike) -> Column:
    """Year-first date in the first ten characters, whatever follows."""
    return F.try_to_date(F.substring(as_column(col), 1, 10), "yyyy-MM-dd")


def parse_date_dmy(col: ColumnLike, formats: tuple[str, ...] = DMY_FORMATS) -> Column:
    text = F.trim(as_column(col))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def to_day(col: ColumnLike) -> Column:
    return as_column(col).cast("date")


def month_index(day: ColumnLike) -> Column:
    day = as_column(day)
    return ((F.year(day) - EPOCH_YEAR) * 12 + F.month(day) - 1).cast("int")


def quarter_index(day: ColumnLike) -> Column:
    day = as_column(day)
    return ((F.year(day) - EPOCH_YEAR) * 4 + F.quarter(day) - 1).cast("int")


def quarter_of_month(month: ColumnLike) -> Column:
    return F.floor(as_column(month) / 3).cast("int")


def month_start(month: ColumnLike) -> Column:
    """First day of a month number."""
    month = as_column(month)
    year = F.floor(month / 12).cast("int")
    return F.make_date(year + EPOCH_YEAR, (month - year * 12 + 1).cast("int"), F.lit(1))


def quarter_start(quarter: ColumnLike) -> Column:
    return month_start(as_column(quarter) * 3)


def ym(year: int | ColumnLike, month: int | ColumnLike) -> int | Column:
    """Month number from year and month: an int from ints, else a column."""
    if isinstance(year, int) and isinstance(month, int):
        return (year - EPOCH_YEAR) * 12 + month - 1
    y = F.lit(year) if isinstance(year, int) else as_column(year)
    m = F.lit(month) if isinstance(month, int) else as_column(month)
    return ((y - EPOCH_YEAR) * 12 + m - 1).cast("int")


def yq(year: int | ColumnLike, quarter: int | ColumnLike) -> int | Column:
    """Quarter number from year and quarter: an int from ints, else a column."""
    if isinstance(year, int) and isinstance(quarter, int):
        return (year - EPOCH_YEAR) * 4 + quarter - 1
    y = F.lit(year) if isinstance(year, int) else as_column(year)
    q = F.lit(quarter) if isinstance(quarter, int) else as_column(quarter)
    return ((y - EPOCH_YEAR) * 4 + q - 1).cast("int")


def period(text: str) -> int:
    """`2022q1` or `2022m9` to its number."""
    match = re.fullmatch(r"(\d{4})([qm])(\d{1,2})", text)
    if not match:
        raise ValueError(f"not a period: {text!r}")
    year, unit, part = int(match[1]), match[2], int(match[3])
    return yq(year, part) if unit == "q" else ym(year, part)


def first_day(month: int) -> dt.date:
    """First day of a month number, on the driver; used for pushed date bounds."""
    return dt.date(EPOCH_YEAR + month // 12, month % 12 + 1, 1)


def quarter_label(quarter: ColumnLike) -> Column:
    quarter = as_column(quarter)
    year = F.floor(quarter / 4).cast("int")
    return F.concat((year + EPOCH_YEAR).cast("string"), F.lit("q"),
                    (quarter - year * 4 + 1).cast("string"))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.datediff(as_column(later), as_column(earlier))


def event_time(period_col: ColumnLike, first_period: ColumnLike) -> Column:
    return (as_column(period_col) - as_column(first_period)).cast("int")


def age_in(year: int, year_of_birth: ColumnLike) -> Column:
    return (F.lit(year) - as_column(year_of_birth)).cast("int")
