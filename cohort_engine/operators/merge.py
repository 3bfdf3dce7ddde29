"""Merging two tables with a match status, and the lookups built on it.

A merge names its kind, and the kind decides the plan: the side that may hold many
rows per key is always the side adaptive execution can split, so that a hot key never
lands in one task. A full outer join could not be split on either side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import truth
from .keys import PREFIX, as_list, match_on, members, prefixed, with_known_keys

LEFT_ONLY, RIGHT_ONLY, MATCHED = 1, 2, 3
KINDS = ("1:1", "1:m", "m:1")


def is_unique(df: DataFrame, keys: str | Sequence[str]) -> bool:
    """Whether no key repeats; runs one aggregation."""
    counts = df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter("__n > 1").isEmpty()


def assert_unique(df: DataFrame, keys: str | Sequence[str], null_safe: bool = True) -> DataFrame:
    """The same rows, in a plan that fails at run time if a key repeats. Without `null_safe`,
    rows that miss a part of their key match nothing and may repeat."""
    keys = as_list(keys)
    if not null_safe:
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.col(k).isNull()
        return assert_unique(df.filter(~missing), keys).unionByName(df.filter(missing))
    rest = [c for c in df.columns if c not in keys]
    row = F.any_value(F.struct(*rest)).alias("__row") if rest else F.any_value(F.lit(0)).alias("__row")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), row)
    failure = F.raise_error(F.lit(f"key {keys} is not unique")).cast("boolean")
    checked = grouped.filter(F.when(F.col("__n") > 1, failure).otherwise(F.lit(True)))
    return checked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def merge_tables(left: DataFrame, right: DataFrame, on: str | Sequence[str], kind: str,
                 keep: Sequence[int] = (LEFT_ONLY, RIGHT_ONLY, MATCHED),
                 using: Sequence[str] | None = None, indicator: str | None = "_merge",
                 validate: bool = True, null_safe: bool = True, grouped: bool = False) -> DataFrame:
    """Merge on equal keys; the status is 1 left only, 2 right only, 3 matched.

    A column both sides have keeps the left value, except in right-only rows. `using`
    takes only those right columns. The query fails if a side said to be unique is not;
    turn `validate` off only where the sides were just grouped by the key. With `grouped`, the
    left side was just grouped by the key too: matched rows of keys that are not null-safe
    then come from a join on plain equality, which moves neither side once more.
    """
    on = as_list(on)
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if using is not None:
        right = right.select(*on, *[c for c in using if c not in on])
    if validate and kind[0] == "1":
        left = assert_unique(left, on, null_safe)
    plainly = grouped and not null_safe and set(keep) == {MATCHED}
    if plainly:  # rows missing a key match nothing, so only the others are looked at
        right = with_known_keys(right, on)
    if validate and kind[2] == "1":
        right = assert_unique(right, on, null_safe or plainly)
    keep = set(keep)
    extra = [c for c in right.columns if c not in left.columns]
    shared = set(right.columns) & set(left.columns)
    # no key can be hot where both sides were grouped by it
    cond = [F.col(k) == F.col(PREFIX + k) for k in on] if plainly else match_on(on)

    def matchable(df: DataFrame) -> DataFrame:
        """The side looked up in: without null-safe keys, rows missing one match nothing."""
        return df if null_safe else with_known_keys(df, on)

    def as_left(df: DataFrame) -> DataFrame:
        return df.withColumn("__l", F.lit(1))

    def as_right(df: DataFrame) -> DataFrame:
        return prefixed(df, df.columns).withColumn("__r", F.lit(1))

    def finish(df: DataFrame, how: str) -> DataFrame:
        """Project a join result; `how` names the sides a row can come from."""
        def pick(c: str) -> Column:
            theirs = F.col(PREFIX + c)
            if how == "right":
                return theirs if c in shared else F.lit(None).cast(left.schema[c].dataType)
            if how == "any" and c in shared:
                return F.when(F.col("__l").isNull(), theirs).otherwise(F.col(c))
            return F.col(c)

        out = [pick(c).alias(c) for c in left.columns]
        for c in extra:
            kind_ = right.schema[c].dataType
            out.append((F.lit(None).cast(kind_) if how == "left" else F.col(PREFIX + c)).alias(c))
        if indicator:
            status = {"left": F.lit(LEFT_ONLY), "right": F.lit(RIGHT_ONLY), "both": F.lit(MATCHED)}.get(how)
            if status is None:
                status = (F.when(F.col("__l").isNull(), RIGHT_ONLY)
                          .when(F.col("__r").isNull(), LEFT_ONLY).otherwise(MATCHED))
            out.append(status.cast("int").alias(indicator))
        return df.select(*out)

    def left_rest() -> DataFrame:
        keys = matchable(right.select(*on)).distinct()
        return finish(as_left(left).join(prefixed(keys, on), cond, "left_anti"), "left")

    def right_rest() -> DataFrame:
        keys = matchable(left.select(*on)).distinct()
        return finish(as_right(right).join(keys, cond, "left_anti"), "right")

    if kind == "1:1" and {LEFT_ONLY, RIGHT_ONLY} <= keep:
        # no key can be hot here; plain equality reuses the partitioning the sides have
        plain = [F.col(k) == F.col(PREFIX + k) for k in on]
        full = finish(as_left(left).join(as_right(right), cond if null_safe else plain, "full"), "any")
        if MATCHED in keep:
            return full
        return left_rest().unionByName(right_rest())
    parts = []
    many_left = kind != "1:m"
    probe_only = LEFT_ONLY if many_left else RIGHT_ONLY
    if MATCHED in keep and probe_only in keep:
        # the probing side is the one whose hot keys can be split
        joined = (as_left(left).join(as_right(matchable(right)), cond, "left") if many_left
                  else as_right(right).join(as_left(matchable(left)), cond, "left"))
        parts.append(finish(joined, "any"))
        keep -= {MATCHED, probe_only}
    if MATCHED in keep:
        parts.append(finish(as_left(left).join(as_right(matchable(right)), cond, "inner"), "both"))
    if LEFT_ONLY in keep:
        parts.append(left_rest())
    if RIGHT_ONLY in keep:
        parts.append(right_rest())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_match(left: DataFrame, right: DataFrame, on: str | Sequence[str], kind: str = "1:1",
                null_safe: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched rows, rows only on the left, rows only on the right)."""
    matched = merge_tables(left, right, on, kind, keep=(MATCHED,), indicator=None, null_safe=null_safe)
    left_only = members(left, right, on, null_safe, inside=False)
    right_only = members(right, left, on, null_safe, inside=False)
    return matched, left_only, right_only


def merge_keep_or(left: DataFrame, right: DataFrame, on: str | Sequence[str], cond: Column,
                  using: Sequence[str] | None = None, null_safe: bool = True) -> DataFrame:
    """Keep rows that found a match, or that meet a condition without one."""
    merged = merge_tables(left, right, on, "m:1", keep=(LEFT_ONLY, MATCHED), using=using,
                          indicator="__merge", null_safe=null_safe)
    return merged.filter((F.col("__merge") == MATCHED) | truth(cond)).drop("__merge")


def lookup(df: DataFrame, table: DataFrame, key: str | Sequence[str],
           columns: Sequence[str] | None = None, required: bool = True,
           null_safe: bool = False, validate: bool = True, grouped: bool = False) -> DataFrame:
    """Columns of a table that holds one row per key, which is checked. Spark broadcasts the table when
    its measured size allows; otherwise hot keys of `df` are split. With `grouped`, `df` was just grouped by
    the key and has none."""
    keep = (MATCHED,) if required else (LEFT_ONLY, MATCHED)
    return merge_tables(df, table, key, "m:1", keep=keep, using=columns, indicator=None,
                        null_safe=null_safe, validate=validate, grouped=grouped)


def map_to_person(df: DataFrame, patient: DataFrame, site_key: str, person: str | Sequence[str],
                  validate: bool = True, grouped: bool = False) -> DataFrame:
    """Person columns of a site-level key; rows with an unknown key drop out. `grouped` says that
    `df` was just grouped by the key."""
    return lookup(df, patient, site_key, as_list(person), validate=validate, grouped=grouped)


def cross_panel(persons: DataFrame, start: int, end: int, period: str = "q") -> DataFrame:
    """Every person in every period from start to end: rows are generated from a
    constant list of periods, so there is neither a join nor a shuffle."""
    return persons.withColumn(period, F.explode(F.sequence(F.lit(start), F.lit(end))))


def cross_fill(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Set columns from others where a condition holds: `{column: (value, condition)}`."""
    return df.withColumns({c: F.when(truth(cond), value).otherwise(F.col(c))
                           for c, (value, cond) in rules.items()})


def align_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Cast the columns both frames have to the types of `like`."""
    wanted = {f.name: f.dataType for f in like.schema}
    return df.select(*[F.col(c).cast(wanted[c]) if c in wanted else F.col(c) for c in df.columns])


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is missing there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
