"""Per-group sequence, first row, size and statistics on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .collapse import dedupe
from .keys import as_list, attach
from .ordering import group_index, nulls_last

def first_in_group(df: DataFrame, by: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    return dedupe(df, by, order)


def first_k(df: DataFrame, by: str | Sequence[str], order: Sequence[str], k: int,
            out: str = "seq") -> DataFrame:
    """The first k rows of each group with their number. Spark cuts groups to k rows in
    each map task before the shuffle, if k is not above its own limit for that."""
    w = W.partitionBy(*as_list(by)).orderBy(*nulls_last(order))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def seq_in_group(df: DataFrame, by: str | Sequence[str], order: Sequence[str],
                 out: str = "seq") -> DataFrame:
    """Number from 1 of every row in its group, missing values last. `order` must be total
    in the group. A hot group is spread over many tasks."""
    return group_index(df, by, order, out)


def group_stats(df: DataFrame, by: str | Sequence[str], stats: Mapping[str, Column],
                null_safe: bool = True) -> DataFrame:
    """Aggregates of the group on every row: `{output: aggregate}`."""
    groups = df.groupBy(*as_list(by)).agg(*[a.alias(o) for o, a in stats.items()])
    return attach(df, groups, by, null_safe=null_safe)


def group_size(df: DataFrame, by: str | Sequence[str], out: str = "n") -> DataFrame:
    return group_stats(df, by, {out: F.count(F.lit(1))})


def first_flag(df: DataFrame, by: str | Sequence[str], order: Sequence[str],
               out: str = "first") -> DataFrame:
    """1 on the first row of each group by a total order, else 0."""
    by, order = as_list(by), list(order)
    rank = F.struct(*[c for o in order for c in (F.col(o).isNull(), F.col(o))])
    heads = df.groupBy(*by).agg(F.min(rank).alias("__head"))
    flagged = attach(df, heads, by)
    return flagged.withColumn(out, rank.eqNullSafe(F.col("__head")).cast("int")).drop("__head")


def nth_dates(df: DataFrame, key: str | Sequence[str], date: str, wanted: Mapping[str, tuple],
              status: str | None = None, tie_break: Sequence[str] = (),
              extra: Mapping[str, Column] | None = None) -> DataFrame:
    """n-th date of each status, one row per key.

    `wanted` is `{output: (status value, n)}`; without `status` all rows are one series
    and the value is ignored. Every key keeps its row even if nothing is found. One
    numbering pass limited to the largest n, then one conditional aggregate. `extra`
    adds aggregates to it that depend only on which statuses a key has.
    """
    key = as_list(key)
    group = key + ([status] if status else [])
    most = max(n for _, n in wanted.values())
    numbered = first_k(df, group, [date, *tie_break], most, "__seq")

    def pick(value, n):
        cond = F.col("__seq") == n
        return cond & (F.col(status) == value) if status else cond

    return numbered.groupBy(*key).agg(
        *[F.min(F.when(pick(v, n), F.col(date))).alias(o) for o, (v, n) in wanted.items()],
        *[a.alias(o) for o, a in (extra or {}).items()])
