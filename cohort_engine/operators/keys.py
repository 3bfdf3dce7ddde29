"""Joining on keys where a missing key equals a missing key.

`attach` and `members` are how the engine puts a per-group result back on rows. They
replace window functions over a group of any size: the group is reduced by a hash
aggregate (partial on the map side), and in the join back the reduced side has one
row per key, so adaptive execution can split a hot key on the row side.

Adaptive execution splits a hot key only if both sides of the join come straight from an
exchange. A side aggregated on the very same key would not: it is already partitioned.
The null-safe condition is planned on derived keys, so it always brings that exchange,
at the price of moving the reduced side once more. It is therefore used for keys that
hold no nulls too; rows with a null key are then taken out of the reduced side.
"""

from __future__ import annotations

from collections.abc import Sequence

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFIX = "__r_"


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def match_on(keys: Sequence[str], prefix: str = PREFIX) -> list[Column]:
    """Null-safe conditions `key = prefix+key`."""
    return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys]


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str = PREFIX) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def with_known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a missing key."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def attach(df: DataFrame, groups: DataFrame, keys: str | Sequence[str], how: str = "left",
           null_safe: bool = True) -> DataFrame:
    """Put the columns of `groups` (one row per key) on every row of `df`."""
    keys = as_list(keys)
    if not null_safe:
        groups = with_known_keys(groups, keys)
    joined = df.join(prefixed(groups, keys), match_on(keys), how)
    return joined.drop(*[PREFIX + k for k in keys])


def members(df: DataFrame, keys_of: DataFrame, keys: str | Sequence[str],
            null_safe: bool = True, inside: bool = True) -> DataFrame:
    """Rows of `df` whose key is in `keys_of` (or is not, with `inside=False`)."""
    keys = as_list(keys)
    wanted = keys_of.select(*keys)
    if not null_safe:
        wanted = with_known_keys(wanted, keys)
    how = "left_semi" if inside else "left_anti"
    return df.join(prefixed(wanted.distinct(), keys), match_on(keys), how)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A short table written as constants, so that Spark knows its size. `schema` is
    `(name, type)` pairs."""
    def value(x: Any, kind: str) -> Column:
        return F.lit(x).cast(kind)

    entries = [F.struct(*[value(x, kind).alias(name) for x, (name, kind) in zip(row, schema)]) for row in rows]
    one = spark.range(1)
    if not entries:
        return one.limit(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in schema])
    return one.select(F.inline(F.array(*entries)))
