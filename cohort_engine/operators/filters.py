"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import first_day
from ..functions.missing import ge, le, truth
from .keys import as_list, members


def keep_if(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(cond)


def drop_if(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows where the condition is known to hold; unknown keeps the row."""
    return df.filter(~truth(cond))


def in_window(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    """Keep rows whose month is in the closed range of month numbers; missing drops.

    On a date or timestamp column the bounds become day bounds on the raw column, so
    that the filter is pushed to the reader and skips row groups.
    """
    if isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        start, end = first_day(low), first_day(high + 1)
        kind = df.schema[col].dataType
        return df.filter((F.col(col) >= F.lit(start).cast(kind)) & (F.col(col) < F.lit(end).cast(kind)))
    return df.filter(F.col(col).between(low, high))


def exclude(df: DataFrame, exclusions: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Drop rows whose key is on an exclusion list."""
    return members(df, exclusions, key, null_safe=False, inside=False)


def keep_groups_any(df: DataFrame, keys: str | Sequence[str], cond: Column,
                    null_safe: bool = True) -> DataFrame:
    """Keep every row of the groups in which some row meets the condition."""
    return members(df, df.filter(cond), keys, null_safe)


def keep_unique_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs once. Rows with the same missing key parts are one
    group. One aggregate: a key repeated any number of times leaves each map task as a
    single row, and nothing is joined back."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.any_value(F.struct(*rest)).alias("__row") if rest else F.lit(None).alias("__row")
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), row).filter("__n = 1")
    return once.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def sd_bound(df: DataFrame, col: str, key: str | Sequence[str], cond: Column, k: float,
             lower: bool = True, round_out: bool = True) -> DataFrame:
    """One row, one column: mean minus (plus) k standard deviations of `col` over the
    distinct persons meeting `cond`, rounded up (down) to a whole number if asked."""
    people = df.filter(cond).groupBy(*as_list(key)).agg(F.max(col).alias("v"))
    bound = F.avg("v") - k * F.stddev_samp("v") if lower else F.avg("v") + k * F.stddev_samp("v")
    if round_out:
        bound = F.ceil(bound) if lower else F.floor(bound)
    return people.agg(bound.cast("double").alias("bound"))


def trim_by_sd(df: DataFrame, col: str, key: str | Sequence[str], cond: Column, k: float = 3,
               lower: bool = True, round_out: bool = True) -> DataFrame:
    """Drop values more than k standard deviations below (above) the mean of a
    reference group. A missing value counts as large: kept by a lower bound, dropped by
    an upper one. The bound is a scalar subquery, so no join is made."""
    bound = sd_bound(df, col, key, cond, k, lower, round_out).scalar()
    return df.filter(ge(col, bound) if lower else le(col, bound))


def censor_after(df: DataFrame, period: str, end: str, start: int | None = None) -> DataFrame:
    """Drop periods at or after a person's end period, and persons whose end is before
    the study starts."""
    out = df.filter(F.col(end).isNull() | (F.col(period) < F.col(end)))
    if start is not None:
        out = out.filter(F.col(end).isNull() | (F.col(end) >= start))
    return out
