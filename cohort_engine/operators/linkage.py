"""Deterministic record linkage on a composite key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import days_between
from .filters import keep_unique_keys
from .keys import as_list, members
from .merge import merge_tables


def normalise_keys(df: DataFrame, rules: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Bring each link key to one type and spelling, so that e.g. birth month "03" and
    "3" agree: `{column: expression}`."""
    return df.withColumns({k: fn(F.col(k)) for k, fn in rules.items()})


def link_exact(left: DataFrame, right: DataFrame, keys: str | Sequence[str],
               left_unique: bool = False, right_unique: bool = False) -> DataFrame:
    """Pairs that agree on every key, among keys that occur once on each side.

    Ambiguous keys are dropped first, so the join is one to one and no key, missing or
    not, can be hot in it. A column both sides have keeps the left value.
    """
    left = left if left_unique else keep_unique_keys(left, keys)
    right = right if right_unique else keep_unique_keys(right, keys)
    # both sides hold only keys that occur once
    return merge_tables(left, right, keys, "1:1", keep=(3,), indicator=None, validate=False)


def link_cascade(source: DataFrame, pools: Sequence[DataFrame], keys: str | Sequence[str],
                 pass_column: str = "link_pass") -> tuple[DataFrame, DataFrame]:
    """Link a source to the first pool, what is left of it to the second, and so on.

    Returns (linked rows with the pass that found them, source rows never linked). The
    two are disjoint, and together hold every source row with an unambiguous key.

    Source and pools are stacked and shuffled once, by the link key. One aggregate knows for each key how
    often every side has it, and so whether it is ambiguous there and which pass is the first to
    match. A column that several sides have keeps the value of the source, or of the pool that matched.
    """
    keys, sides = as_list(keys), [source, *pools]
    stacked = None
    for i, side in enumerate(sides):
        own = F.struct(F.lit(i).alias("__side"), *[F.col(c) for c in side.columns if c not in keys])
        part = side.select(*keys, F.lit(i).alias("__side"), own.alias(f"__row{i}"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    counts = [F.count_if(F.col("__side") == i).alias(f"__n{i}") for i in range(len(sides))]
    found = stacked.groupBy(*keys).agg(*counts, *[F.any_value(f"__row{i}", True).alias(f"__row{i}") for i in range(len(sides))]).filter("__n0 = 1")
    number = F.coalesce(*[F.when(F.col(f"__n{i}") == 1, F.lit(i)) for i in range(1, len(sides))])
    found = found.withColumn(pass_column, number)

    def left(c: str) -> Column:
        return F.col(c) if c in keys else F.col("__row0")[c].alias(c)

    def right(c: str) -> Column:
        return F.coalesce(*[F.when(F.col(pass_column) == i, F.col(f"__row{i}")[c]) for i, p in enumerate(pools, start=1) if c in p.columns]).alias(c)

    kept = list(source.columns)
    added = list(dict.fromkeys(c for p in pools for c in p.columns if c not in kept))
    linked = found.filter(F.col(pass_column).isNotNull()).select(*map(left, kept), *map(right, added), pass_column)
    return linked, found.filter(F.col(pass_column).isNull()).select(*map(left, kept))


def review_candidates(pairs: DataFrame, date_pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Linked pairs with the distance in days of the dates a reviewer compares, and
    the widest of them: `{output: (date of one source, date of the other)}`."""
    gaps = {out: days_between(a, b) for out, (a, b) in date_pairs.items()}
    widest = F.greatest(*[F.abs(g) for g in gaps.values()]) if len(gaps) > 1 else F.abs(*gaps.values())
    known = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in date_pairs.values()]
    comparable = known[0]
    for k in known[1:]:
        comparable = comparable | k
    return pairs.withColumns({**gaps, "widest_gap": widest, "comparable": comparable.cast("int")})


def apply_review(pairs: DataFrame, decisions: DataFrame, key: str | Sequence[str],
                 verdict: str = "keep", default_keep: bool = False) -> DataFrame:
    """Pairs a reviewer approved. With `default_keep`, pairs nobody refused."""
    if default_keep:
        return members(pairs, decisions.filter(F.col(verdict) == 0), key, inside=False)
    return members(pairs, decisions.filter(F.col(verdict) == 1), key)
