"""The whole study in three stages: sample, panel, model.

Each stage takes and returns DataFrames, so a user can store the result of a stage and
start the next from the stored table. Source tables carry the column names listed in
FIXTURES.md part A, with raw columns as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_index, parse_date, parse_date_prefix, parse_datetime, period, to_day
from ..functions.missing import is_missing
from ..operators.did import did_batch
from ..operators.filters import censor_after
from ..operators.matching import cem
from ..operators.merge import append, merge_tables
from ..operators.report import Attrition
from . import values
from .conditions import condition_profile
from .events import any_class_count, category_counts, clean_events, event_counts, sample_map
from .linking import link_rosters, one_row_each
from .panel import (build_panel, derive_outcomes, derive_strata, died_on, end_of_followup,
                    event_study_columns, spell_days, text_end)
from .rosters import RosterSpec, roster_profile
from .sample import SampleParams, build_sample, reconcile_conditions
from .timelines import status_timeline

KEY, PERSON = "patientsitekey", "person_id"


@dataclass
class StudyParams:
    months: tuple[str, str] = values.STUDY_MONTHS
    quarters: tuple[str, str] = values.STUDY_QUARTERS
    year: int = 2025
    enrolled: str = "Program Enrolled"
    graduated: str = "Program Graduated"
    withdrawn: str = "Program Withdrawn"
    referred: Sequence[str] = ("Program Referred", "Program  Referred")
    eligible: str = "Program Eligible"
    excluded_quarter: str = "2025q4"
    site_aliases: Mapping[str, str] = field(default_factory=dict)
    cutoff: str = "2025-10-01"
    lead: int = 4
    effects: int = 10
    placebo: int = 5

    @property
    def window(self) -> tuple[int, int]:
        return period(self.months[0]), period(self.months[1])

    @property
    def span(self) -> tuple[int, int]:
        return period(self.quarters[0]), period(self.quarters[1])


def roster_a(tables: Mapping[str, DataFrame], params: StudyParams) -> DataFrame:
    roster = tables["roster_a"].withColumn("birth_date", parse_date("dob"))
    spec = RosterSpec(
        key="key", link_keys=values.LINK_KEYS, birth_date="birth_date", site_aliases=params.site_aliases,
        series={"enrolled": ("enrolled", 3), "graduated": ("graduated", 3), "withdrawn": ("withdrawn", 3)},
        repeat_keys=("key", "enrolled"), first_by=("withdrawn",), condition="diagnosis",
        condition_sets=values.ROSTER_A_CONDITIONS, suffix="_a", keep=("withdrawal_reason", "referral_a"))
    return roster_profile(roster.withColumnRenamed("referral", "referral_a"),
                          tables["roster_a_conditions"], spec)


def roster_b(tables: Mapping[str, DataFrame], params: StudyParams) -> DataFrame:
    roster = tables["roster_b"].withColumnsRenamed(
        {"graduated": "graduated_1_b", "withdrawn": "withdrawal_text_b", "referral": "referral_b"})
    spec = RosterSpec(
        key="id", link_keys=values.LINK_KEYS, birth_date="dob", site_key="key",
        series={"enrolled": ("enrolled", 1)}, first_by=("enrolled",), condition="diagnosis_group",
        condition_sets=values.ROSTER_B_CONDITIONS, suffix="_b", keep_unknown=False,
        keep=("graduated_1_b", "withdrawal_text_b", "referral_b"))
    return roster_profile(roster, tables["roster_b_conditions"], spec)


def conditions(tables: Mapping[str, DataFrame], params: StudyParams) -> DataFrame:
    dated = tables["diagnosis"].withColumn(
        "month", month_index(to_day(parse_datetime("diagnosis_recorded_date"))))
    return condition_profile(
        dated, tables["patient"], KEY, PERSON, "chronic_disease_category", "month",
        values.EXTRACT_CONDITIONS, values.ELIGIBLE_CONDITIONS, params.window, "dementia")


def pools(tables: Mapping[str, DataFrame], params: StudyParams) -> tuple[DataFrame, DataFrame]:
    """The ever-enrolled, and those with later statuses only considered adults."""
    flags = tables["patientflag"].withColumn("day", to_day(parse_datetime("flag_datetime")))
    sites, keys = tables.get("excluded_sites"), tables.get("excluded_keys")
    people = ("person_id", "yob", "mob", "sex", "post_code", "practice_id")
    ends = {"graduated_1": ("graduated", 1), "graduated_2": ("graduated", 2),
            "withdrawn_1": ("withdrawn", 1), "withdrawn_2": ("withdrawn", 2)}
    first = status_timeline(
        flags, tables["patient"], KEY, "flag_status", "day",
        [params.enrolled, params.graduated, params.withdrawn],
        {**{f"enrolled_{i}": ("enrolled", i) for i in range(1, 5)}, **ends}, people, ever="enrolled",
        excluded_sites=sites, excluded_keys=keys)
    second = status_timeline(
        flags, tables["patient"], KEY, "flag_status", "day",
        [params.graduated, params.withdrawn, *params.referred],
        {**ends, "referred_1": ("referred", 1)}, people, excluded_sites=sites, adult_in=params.year)
    return first, second


def sample_stage(tables: Mapping[str, DataFrame], params: StudyParams, steps: Attrition | None = None) -> dict[str, DataFrame]:
    """Profiles, linkage and the study sample, with its matched variant; `steps` counts persons
    after each rule of the sample."""
    profile = conditions(tables, params)
    linked, review = link_rosters(
        {"a": roster_a(tables, params), "b": roster_b(tables, params)}, pools(tables, params),
        values.LINK_KEYS, decisions=tables.get("decisions"), person=PERSON, keep_unless_refused=("b",))
    linked = one_row_each(linked, PERSON, ["link_pass", "roster"])
    linked = reconcile_conditions(linked, profile, PERSON, {
        "cardio": ("has_cardio", ["cardio_a", "cardio_b"]),
        "resp": ("has_respiratory", ["resp_a", "resp_b"]),
        "frailty": ("has_muscul", ["frailty_a", "frailty_b"])})
    sample = build_sample(
        tables["patientflag"], tables["patient"], linked.drop("yob", "mob", "sex", "post_code"),
        tables["area_index"], profile,
        SampleParams(eligible_status=params.eligible, year=params.year,
                     conditions=[("cardio", "has_cardio"), ("resp", "has_respiratory"),
                                 ("frailty", "has_muscul")],
                     excluded_quarter=period(params.excluded_quarter)),
        tables.get("excluded_sites"), steps)
    matched = cem(sample.filter(F.col("sex").isin("Male", "Female")), "treated", {"age": values.AGE_CUTS},
                  exact=["sex", "post_code", "cardio", "resp", "frailty"]).filter("cem_matched = 1")
    return {"profile": profile, "linked": linked, "review": review, "sample": sample, "matched": matched}


def _extracts(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """The older extract of a table with the newer one below it, if there are two."""
    older = tables.get(f"{name}_older")
    return tables[name] if older is None else append(older, tables[name])


def panel_stage(tables: Mapping[str, DataFrame], sample: DataFrame, params: StudyParams) -> DataFrame:
    """Event counts on the complete person x quarter panel of the sample."""
    people = sample_map(tables["patient"], sample, KEY, PERSON)
    window, by = params.window, [PERSON, "q"]
    services = _extracts(tables, "service").withColumn(
        "month", month_index(to_day(parse_datetime("service_date"))))
    services = clean_events(services, people, KEY, PERSON, "service_item", "month", window,
                            values.SERVICE_CODE_RANGE)
    services = services.withColumns({"q": F.floor(F.col("month") / 3).cast("int"),
                                     "practice": F.split_part(F.col(KEY), F.lit("-"), F.lit(1))})
    service_counts = event_counts(services, by, "code_num", values.SERVICE_CODE_SETS,
                                  {"prac_num": "practice", "prov_num": "providersitekey"})

    referrals = _extracts(tables, "referral").withColumn(
        "month", month_index(parse_date_prefix("referral_date")))
    tests: dict[str, Column] = {"referral_number": F.lit(True)}
    tests |= {n: F.col("referral_category").isin(*v) for n, v in values.REFERRAL_SETS.items()}
    referral_counts = category_counts(referrals, people, KEY, PERSON, "month", tests, window)

    scripts = _extracts(tables, "prescription").withColumn(
        "month", month_index(parse_date_prefix("prescription_date")))
    scripts = scripts.filter(~is_missing("atc_code") & (F.col("atc_code") != ""))
    letter = F.substring("atc_code", 1, 1)
    letters = {f"presc_atc_{c}": letter == c for c in values.CLASS_LETTERS}
    script_counts = category_counts(scripts, people, KEY, PERSON, "month", letters, window)
    any_counts = any_class_count(scripts, people, KEY, PERSON, "month", letter, values.TOTAL_LETTERS,
                                 window=window)

    def cols(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in by]

    facts = [(df, cols(df)) for df in (service_counts, script_counts, referral_counts, any_counts)]
    # numbers of practices and providers stay missing where there was no service
    fill = [c for _, counted in facts for c in counted if c not in ("prac_num", "prov_num")]
    return build_panel(sample, *params.span, facts, PERSON, fill=fill)


def analysis_panel(panel: DataFrame, params: StudyParams) -> DataFrame:
    """Censor, derive outcomes, strata and event-study columns."""
    out = end_of_followup(panel, died_on("withdrawal_reason", "withdrawn_1_a"),
                          text_end("withdrawal_text_b"), F.col("date_death"), F.col("treated") == 0)
    out = censor_after(out, "q", "q_dead", params.span[0])
    out = derive_outcomes(out, values.COMPOSITES, values.OUTCOMES, values.LOG_SUFFIX)
    duration = spell_days(["graduated_1_a", "graduated_1_b"], ["enrolled_1_a", "enrolled_1_b"],
                          F.lit(params.cutoff).cast("date"))
    out = derive_strata(out, "area_index", "age", duration, sex_values=("Male", "Female"))
    return event_study_columns(out, PERSON, "q", "first_enrol_q", params.lead)


def model_specs() -> dict[str, dict[str, Any]]:
    """Baseline, subgroups, and each duration half against the never treated."""
    return {
        "baseline": {}, "sex": {"by": "sex"}, "area": {"by": "index_half"}, "age": {"by": "age_high"},
        "duration13": {"where": F.col("duration_half").isin(1, 3)},
        "duration23": {"where": F.col("duration_half").isin(2, 3)},
    }


def graduates_only(panel: DataFrame) -> DataFrame:
    """Leave out spells that have started but not ended, at either roster."""
    open_a = F.col("graduated_1_a").isNull() & F.col("enrolled_1_a").isNotNull()
    open_b = F.col("graduated_1_b").isNull() & F.col("enrolled_1_b").isNotNull()
    return panel.filter(~open_a & ~open_b)


def model_stage(analysis: DataFrame, params: StudyParams, outcomes: Sequence[str] | None = None,
                specs: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """All outcomes, raw and logged, under all specifications, as one table of results."""
    outcomes = outcomes or [*values.OUTCOMES, *[o + values.LOG_SUFFIX for o in values.OUTCOMES]]
    return did_batch(analysis, outcomes, PERSON, "tvar", "treat", params.effects, params.placebo,
                     cluster=PERSON, specs=specs or model_specs())


def swap_sample(panel: DataFrame, sample: DataFrame, person: str = PERSON) -> DataFrame:
    """The panel of another sample of the same persons, e.g. the matched one."""
    return merge_tables(panel, sample.select(person), person, "m:1", keep=(3,), indicator=None)
