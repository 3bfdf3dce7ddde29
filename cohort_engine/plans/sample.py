"""The study sample: treated persons and eligible controls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import age_in, days_between, month_index, quarter_of_month, ym
from ..functions.missing import as_flag, le
from ..functions.text import null_marker, split_key, to_number
from ..operators.collapse import dedupe
from ..operators.filters import exclude, trim_by_sd
from ..operators.keys import attach
from ..operators.merge import assert_unique, lookup, map_to_person, merge_keep_or, merge_tables
from ..operators.report import Attrition
from ..session import stable


def reconcile_conditions(linked: DataFrame, profile: DataFrame, person: str,
                         sources: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """One flag per condition from two kinds of source.

    `sources` is `{output: (profile flag, roster flags)}`. A roster flag is raised by the
    profile only where the roster has a value at all; the output is 1 if any roster flag
    ends up raised. `no_cond` marks persons with none of the conditions.
    """
    columns = [flag for flag, _ in sources.values()]
    merged = merge_tables(linked, profile.select(person, *columns), person, "1:1", keep=(1, 3),
                          indicator=None)
    out: dict[str, Column] = {}
    for name, (flag, rosters) in sources.items():
        raised = [F.when(F.col(r).isNotNull(), as_flag((F.col(r) == 1) | (F.col(flag) == 1)))
                  for r in rosters]
        out[name] = F.coalesce(F.greatest(*raised) if len(raised) > 1 else raised[0], F.lit(0))
    none = [F.col(n) == 0 for n in out]
    cond = none[0]
    for c in none[1:]:
        cond = cond & c
    merged = merged.withColumns(out).withColumn("no_cond", as_flag(cond))
    drop = set(columns) | {r for _, rs in sources.values() for r in rs}
    return merged.drop(*(drop - set(out)))


@dataclass
class SampleParams:
    site_key: str = "patientsitekey"
    person: str = "person_id"
    status: str = "flag_status"
    eligible_status: str = "Eligible"
    demographics: Sequence[str] = ("yob", "mob", "post_code", "sex")
    enrolled_first: str = "enrolled_1_a"  # wins over the second where both exist
    enrolled_second: str = "enrolled_1_b"
    withdrawn: str = "withdrawn_1_a"
    early_days: int = 3
    year: int = 2025
    min_age: int = 18
    conditions: Sequence[tuple[str, str]] = ()  # (sample flag, profile flag)
    excluded_quarter: int | None = None
    sd_limit: float = 3


def build_sample(flags: DataFrame, patient: DataFrame, linked: DataFrame, index: DataFrame,
                 profile: DataFrame, params: SampleParams,
                 excluded_sites: DataFrame | None = None, steps: Attrition | None = None) -> DataFrame:
    """One row per person: every linked (treated) person and every eligible control.

    Flag rows shrink to one per site key before any join. With `steps`, persons are counted after each
    rule, by the job that stores the sample for its outlier rule and the one that uses the result.
    """
    p = params

    def passed(name: str, df: DataFrame) -> DataFrame:
        return df if steps is None else steps.passed(name, df)

    key, person = p.site_key, p.person
    rows = flags.groupBy(key).agg(F.max(as_flag(F.col(p.status) == p.eligible_status)).alias("eligible"))
    rows = rows.withColumn("site", split_key(key, 1))
    if excluded_sites is not None:
        rows = exclude(rows, excluded_sites.toDF("site"), "site")
    rows = map_to_person(rows, patient, key, [person, *p.demographics], grouped=True)
    rows = rows.filter(null_marker("post_code").isNotNull())
    rows = rows.withColumn("post_code", to_number("post_code", kind="int"))

    own = [c for c in linked.columns if c not in rows.columns and c != person]
    df = merge_keep_or(rows, linked, person, F.col("eligible") == 1, using=own)
    first = F.coalesce(month_index(p.enrolled_first), month_index(p.enrolled_second))
    df = df.withColumn("first_enrol", first)
    df = df.withColumn("first_enrol_q", quarter_of_month("first_enrol"))
    df = df.filter(~le(days_between(p.withdrawn, p.enrolled_first), p.early_days))
    df = passed("linked or eligible", dedupe(df, person, [key]))

    df = df.withColumn("yob", to_number("yob", kind="int"))
    df = passed("adults", df.filter(age_in(p.year, "yob") >= p.min_age))
    df = passed("known area", lookup(df, index, "post_code"))
    df = df.withColumn("treated", F.col("first_enrol").isNotNull().cast("int"))

    flags_of = [f for _, f in p.conditions]
    # one row per person since `dedupe`, so only the profile is checked
    df = merge_tables(df, assert_unique(profile.select(person, *flags_of), person), person, "1:1", keep=(1, 3), indicator="__m", validate=False)
    df = passed("with conditions or treated", df.filter((F.col("__m") == 3) | (F.col("treated") == 1)).drop("__m"))
    df = df.withColumns({s: F.when(F.col("treated") == 0, F.col(f)).otherwise(F.col(s))
                         for s, f in p.conditions}).drop(*[f for _, f in p.conditions if f not in
                                                           [s for s, _ in p.conditions]])
    df = attach(df, death_quarter(patient, person), person, "inner")
    if p.excluded_quarter is not None:
        df = df.filter(~F.col("first_enrol_q").eqNullSafe(F.lit(p.excluded_quarter)))
    # the outlier rule reads the sample twice, for its bound and for its rows
    df = stable(passed("other start quarters", df.withColumn("age", age_in(p.year, "yob"))))
    return passed("trimmed by age", trim_by_sd(df, "age", person, F.col("treated") == 1, p.sd_limit, lower=True, round_out=True))


def death_quarter(patient: DataFrame, person: str, year: str = "yod", month: str = "mod",
                  out: str = "date_death") -> DataFrame:
    """Earliest quarter of death a person has at any site; one row per person."""
    y, m = to_number(null_marker(year), kind="int"), to_number(null_marker(month), kind="int")
    return patient.groupBy(person).agg(F.min(quarter_of_month(ym(y, m))).alias(out))
