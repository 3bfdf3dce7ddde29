"""Comparisons in which a missing value ranks above every number.

SQL answers "unknown" when a side is null; the source scripts this engine serves do
not: there a missing value is larger than any number and equal to another missing
value. The helpers below never return null, so they may be negated safely, and are
built from AND/OR/IS NULL only, so a comparison with a literal still reaches the
Parquet reader as a pushed filter.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _operand(value: Any) -> tuple[Column, bool]:
    """The right-hand side and whether it can be null. Strings are literals here."""
    if isinstance(value, Column):
        return value, True
    return F.lit(value), value is None


def ge(a: ColumnLike, b: Any) -> Column:
    left, (right, nullable) = as_column(a), _operand(b)
    known = left >= right
    return left.isNull() | ((right.isNotNull() & known) if nullable else known)


def gt(a: ColumnLike, b: Any) -> Column:
    left, (right, nullable) = as_column(a), _operand(b)
    above = left.isNull() | (left > right)
    return (right.isNotNull() & above) if nullable else above


def lt(a: ColumnLike, b: Any) -> Column:
    left, (right, nullable) = as_column(a), _operand(b)
    below = left.isNotNull() & (left < right)
    return (left.isNotNull() & (right.isNull() | (left < right))) if nullable else below


def le(a: ColumnLike, b: Any) -> Column:
    left, (right, nullable) = as_column(a), _operand(b)
    below = left.isNotNull() & (left <= right)
    return (right.isNull() | below) if nullable else below


def eq(a: ColumnLike, b: Any) -> Column:
    return as_column(a).eqNullSafe(b)


def ne(a: ColumnLike, b: Any) -> Column:
    return ~eq(a, b)


def in_range(a: ColumnLike, low: Any, high: Any) -> Column:
    """Closed range; a missing value is outside."""
    col = as_column(a)
    return col.isNotNull() & col.between(low, high)


def is_missing(col: ColumnLike) -> Column:
    return as_column(col).isNull()


def truth(cond: Column) -> Column:
    """An unknown condition counts as false."""
    return F.coalesce(cond, F.lit(False))


def as_flag(cond: Column) -> Column:
    """0/1 integer of a condition, 0 when unknown."""
    return truth(cond).cast("int")


def first_non_missing(*cols: ColumnLike) -> Column:
    return F.coalesce(*[as_column(c) for c in cols])
