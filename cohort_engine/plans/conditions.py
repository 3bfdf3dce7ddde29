"""Condition profile of each person from dated diagnoses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import as_flag
from ..operators.merge import map_to_person
from ..session import stable
from .events import dated


def condition_profile(diagnoses: DataFrame, patient: DataFrame, site_key: str, person: str,
                      category: str, when: str, sets: Mapping[str, Sequence[str]],
                      eligible: Sequence[str] | None = None, window: tuple[int, int] | None = None,
                      encoded_first: str | None = None) -> DataFrame:
    """Per person: `has_<name>` flags and `first_<name>` months for each category set.

    Diagnoses shrink to one row per site key and category before they meet the person
    map, so the join and the final aggregate see no repeated events. With `eligible`,
    only persons with at least one of those conditions stay. `encoded_first` names an
    extra set for the label that sorts first of all categories present; persons are then
    stored, one row each, as the label comes from all of them.
    """
    month = "month"
    brief = dated(diagnoses, when, window).groupBy(site_key, category).agg(F.min(month).alias(month))
    mapped = map_to_person(brief, patient, site_key, person)
    tests: dict[str, Column] = {name: F.col(category).isin(*values) for name, values in sets.items()}
    aggs = [F.max(as_flag(t)).alias(f"has_{n}") for n, t in tests.items()]
    aggs += [F.min(F.when(t, F.col(month))).alias(f"first_{n}") for n, t in tests.items()]
    if encoded_first:
        aggs.append(F.min(F.when(F.col(category).isNotNull(), F.struct(category, F.col(month).isNull().alias("n"), month))).alias("__least"))
    out = mapped.groupBy(person).agg(*aggs)
    if encoded_first:
        # One label is least of all persons' least ones: the pass over events and person map serves both.
        out = stable(out)
        lowest = F.col("__least")[category] == out.agg(F.min(F.col("__least")[category])).scalar()
        out = out.withColumns({f"has_{encoded_first}": as_flag(lowest), f"first_{encoded_first}": F.when(lowest, F.col("__least")[month])}).drop("__least")
    if eligible:
        total = sum((F.col(f"has_{n}") for n in eligible[1:]), F.col(f"has_{eligible[0]}"))
        out = out.filter(total > 0)
    return out
