"""Row-wise arithmetic, indicators and labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

from .missing import ColumnLike, as_column, as_flag


def row_total(*cols: ColumnLike) -> Column:
    """Sum across columns, missing as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_column(c), F.lit(0)) for c in cols])


def row_sum(*cols: ColumnLike) -> Column:
    """Sum across columns, missing when any is missing."""
    return reduce(lambda a, b: a + b, [as_column(c) for c in cols])


def range_flag(col: ColumnLike, low: Any, high: Any) -> Column:
    return as_flag(as_column(col).between(low, high))


def member_flag(col: ColumnLike, values: Iterable[Any]) -> Column:
    return as_flag(as_column(col).isin(*values))


def label_values(col: ColumnLike, labels: Mapping[Any, str]) -> Column:
    """Text label of a code; unlisted codes have none."""
    source = as_column(col)
    out = F.lit(None).cast("string")
    for value, label in reversed(list(labels.items())):
        out = F.when(source.eqNullSafe(F.lit(value)), F.lit(label)).otherwise(out)
    return out


def log_plus(col: ColumnLike, c: float = 0.1) -> Column:
    return F.log(as_column(col) + F.lit(c))
