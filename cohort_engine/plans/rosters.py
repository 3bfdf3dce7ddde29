"""Provider rosters: one row per person, with dates, condition flags and a link key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import recode, split_key, to_number
from ..operators.collapse import any_by, dedupe
from ..operators.filters import keep_unique_keys
from ..operators.merge import lookup, merge_tables
from ..operators.windows import nth_dates


@dataclass
class RosterSpec:
    key: str
    link_keys: Sequence[str]
    birth_date: str  # a date column
    site: str = "practice_id"
    site_key: str | None = None  # take the site from the first part of this key
    site_aliases: Mapping[str, str] = field(default_factory=dict)
    series: Mapping[str, tuple[str, int]] = field(default_factory=dict)  # prefix: (column, how many)
    first_by: Sequence[str] = ()  # order that picks the row whose other columns are kept
    repeat_keys: Sequence[str] = ()  # rows equal on these are the same enrolment
    condition_key: str | None = None
    condition: str = "diagnosis"
    condition_sets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    suffix: str = ""
    keep_unknown: bool = True  # keep condition rows of persons not on the roster
    keep: Sequence[str] = ()  # other columns to keep


def enrich_roster(births: DataFrame, spells: DataFrame, key: str, order: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Combine two versions of a roster: one row per person of the first, all rows of the
    second, inner on the key. A column both have comes from the first."""
    return lookup(spells.select(key, *[c for c in spells.columns if c != key and c not in births.columns]),
                  dedupe(births, key, order), key, null_safe=True).select(*columns)


def clean_area_index(raw: DataFrame, mapping: Mapping[str, str], code: str = "post_code",
                     low: int = 3000, high: int = 3999) -> DataFrame:
    """Rename, read the code as a number and keep a code range, which also removes
    heading rows of the sheet."""
    named = raw.withColumnsRenamed(dict(mapping)).select(*mapping.values())
    return named.withColumn(code, to_number(code, kind="int")).filter(F.col(code).between(low, high))


def series_dates(df: DataFrame, key: str, series: Mapping[str, tuple[str, int]],
                 suffix: str = "") -> DataFrame:
    """The first n dates of several date columns, one row per key: `prefix_1..n` plus suffix.

    The columns are stacked, so that all series are numbered in one pass.
    """
    stacked = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(prefix).alias("__series"), F.col(c).alias("__date"))
        for prefix, (c, _) in series.items()])))
    wanted = {f"{prefix}_{i}{suffix}": (prefix, i) for prefix, (_, n) in series.items() for i in range(1, n + 1)}
    return nth_dates(stacked, key, "__date", wanted, status="__series")


def roster_profile(roster: DataFrame, conditions: DataFrame, spec: RosterSpec) -> DataFrame:
    """One row per person with an unambiguous link key."""
    key = spec.key
    df = roster
    if spec.site_key:
        df = df.withColumn(spec.site, split_key(spec.site_key, 1))
    if spec.site_aliases:
        df = df.withColumn(spec.site, recode(spec.site, spec.site_aliases))
    rest = sorted(set(df.columns) - {key})
    if spec.repeat_keys:
        df = dedupe(df, spec.repeat_keys, [c for c in rest if c not in spec.repeat_keys])
    first = dedupe(df, key, [*spec.first_by, *[c for c in rest if c not in spec.first_by]])
    dates = series_dates(df, key, spec.series, spec.suffix)
    people = merge_tables(first, dates, key, "1:1", keep=(3,), indicator=None, validate=False)  # both one row per key
    people = people.withColumns({"yob": F.year(spec.birth_date), "mob": F.month(spec.birth_date)})

    flags = {f"{name}{spec.suffix}": F.col(spec.condition).isin(*values)
             for name, values in spec.condition_sets.items()}
    source = conditions.withColumnRenamed(spec.condition_key or key, key)
    found = any_by(source, key, flags)
    keep = (1, 2, 3) if spec.keep_unknown else (1, 3)
    merged = merge_tables(people, found, key, "1:1", keep=keep, indicator="__m", validate=False)  # both one row per key
    filled: dict[str, Column] = {f: F.coalesce(F.col(f), F.lit(0)) for f in flags}
    filled[f"diag_miss{spec.suffix}"] = (F.col("__m") == 1).cast("int")
    merged = merged.withColumns(filled)
    columns = [*spec.link_keys, *dates.columns[1:], *filled, *spec.keep]
    return keep_unique_keys(merged.select(*dict.fromkeys(columns)), spec.link_keys)
