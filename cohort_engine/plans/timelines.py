"""Timelines: repeated status flags to one row per site key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import age_in
from ..functions.text import nth_word, split_key, to_number
from ..operators.filters import drop_if, exclude
from ..operators.merge import merge_tables
from ..operators.windows import nth_dates


def status_timeline(flags: DataFrame, patient: DataFrame, site_key: str, status: str, day: str,
                    statuses: Sequence[str], wanted: Mapping[str, tuple[str, int]],
                    person_columns: Sequence[str], ever: str | None = None,
                    excluded_sites: DataFrame | None = None, excluded_keys: DataFrame | None = None,
                    drop_when: Column | None = None, adult_in: int | None = None,
                    word: int = 2) -> DataFrame:
    """n-th dates of each status (named by a word of the flag text) with the person's
    demographics.

    `ever` keeps only keys that hold that status at least once; it is tested in the same
    aggregate that picks the dates. `adult_in` keeps persons aged 18 or more in a year.
    """
    rows = flags.filter(F.col(status).isin(*statuses))
    rows = rows.withColumn("__site", split_key(site_key, 1))
    if excluded_sites is not None:
        rows = exclude(rows, excluded_sites.toDF("__site"), "__site")
    rows = rows.select(site_key, F.lower(nth_word(status, word)).alias("__status"), day)
    picks = dict(wanted)
    extra = {"__ever": F.max((F.col("__status") == ever).cast("int"))} if ever else {}
    out = nth_dates(rows, site_key, day, picks, status="__status", extra=extra)
    if ever:
        out = out.filter("__ever = 1").drop("__ever")
    out = merge_tables(out, patient, site_key, "1:1", keep=(3,), using=person_columns, indicator=None)
    if excluded_keys is not None:
        out = exclude(out, excluded_keys, site_key)
    if drop_when is not None:
        out = drop_if(out, drop_when)
    if adult_in is not None:
        out = out.withColumn("yob", to_number("yob", kind="int"))
        out = out.filter(age_in(adult_in, "yob") >= 18)
    return out
