"""The person x period panel, censoring, outcomes, strata and treatment timing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import days_between, event_time, parse_date_dmy, quarter_index
from ..functions.missing import as_flag, ge, truth
from ..functions.scalars import log_plus, row_sum
from ..operators.collapse import collapse_sum
from ..operators.merge import append, assert_unique, cross_panel, merge_tables
from ..operators.ordering import xtile
from ..operators.projections import group_id, zero_fill
from ..session import stable


def build_panel(sample: DataFrame, start: int, end: int, facts: Sequence[tuple[DataFrame, Sequence[str]]],
                person: str, period: str = "q", keep_outside: bool = True, fill: Sequence[str] | None = None) -> DataFrame:
    """Every sampled person in every period, with the counts and 0 where there are none (in
    the columns `fill`, all by default).

    The fact tables (one row per person and period each) are stacked and summed, so
    that the panel is joined once. Facts outside the panel are kept as rows, as a merge
    without a keep list does, unless `keep_outside` is off.
    """
    columns = [c for _, cols in facts for c in cols]
    stacked = append(*[df.select(person, period, *cols) for df, cols in facts])
    counts = collapse_sum(stacked, [person, period], columns) if len(facts) > 1 else assert_unique(stacked, [person, period])
    panel = cross_panel(assert_unique(sample, person), start, end, period)
    keep = (1, 2, 3) if keep_outside else (1, 3)
    # the persons were checked before their periods were made, the counts are one row per key
    merged = merge_tables(panel, counts, [person, period], "1:1", keep=keep, indicator=None, null_safe=False, validate=False)
    return zero_fill(merged, columns if fill is None else fill)


def end_of_followup(panel: DataFrame, died_on: Column, other_end: Column, registry_quarter: Column,
                    control: Column, out: str = "q_dead") -> DataFrame:
    """Quarter in which a person leaves: the date of a withdrawal by death, else the other
    roster's end date; for controls the registry's quarter of death, where there is one."""
    quarter = quarter_index(F.coalesce(died_on, other_end))
    use_registry = truth(control) & registry_quarter.isNotNull()
    return panel.withColumn(out, F.when(use_registry, registry_quarter).otherwise(quarter))


def died_on(reason: str, withdrawn: str, value: str = "Died") -> Column:
    return F.when(F.col(reason) == value, F.col(withdrawn))


def text_end(col: str) -> Column:
    return parse_date_dmy(col)


def derive_outcomes(panel: DataFrame, composites: Mapping[str, Sequence[str]],
                    logged: Sequence[str] = (), suffix: str = "_LN", c: float = 0.1) -> DataFrame:
    """Composite outcomes as sums, and log(x + c) copies."""
    out = panel.withColumns({name: row_sum(*parts) for name, parts in composites.items()})
    return out.withColumns({n + suffix: log_plus(n, c) for n in logged}) if logged else out


def spell_days(end: Sequence[str], start: Sequence[str], cutoff: Column) -> Column:
    """Programme days from several pairs of (end, start) dates, the first complete pair
    winning; a started spell without an end runs to the cut-off, later pairs first."""
    pairs = list(zip(end, start))
    done = F.coalesce(*[days_between(e, s) for e, s in pairs])
    for e, s in reversed(pairs):
        open_ = F.col(s).isNotNull() & F.col(e).isNull()
        done = F.when(open_, days_between(cutoff, s)).otherwise(done)
    return done


def derive_strata(panel: DataFrame, index: str, age: str, duration: Column, age_cut: int = 81,
                  sex: str = "sex", sex_values: Sequence[str] | None = None) -> DataFrame:
    """Area-index halves, age class and programme-duration halves (3 = never treated).

    Halves are by value over the rows of the panel. With `sex_values`, rows of other
    values are dropped, after the area halves are cut and before the duration halves. Only the
    columns that the cuts need are stored; the panel itself is read once.
    """
    cut = stable(panel.select(F.col(index).alias("index"), duration.alias("days"), F.col(sex).alias("sex")))
    out = xtile(panel, index, 2, "index_half", cut.select(F.col("index").alias(index)))
    if sex_values:
        out, cut = out.filter(F.col(sex).isin(*sex_values)), cut.filter(F.col("sex").isin(*sex_values))
    out = out.withColumns({"age_high": as_flag(ge(age, age_cut)), "duration_days": duration})
    out = xtile(out, "duration_days", 2, "duration_half", cut.select(F.col("days").alias("duration_days")))
    return out.withColumn("duration_half", F.coalesce(F.col("duration_half"), F.lit(3)))


def event_study_columns(panel: DataFrame, person: str, period: str, first: str, lead: int = 4) -> DataFrame:
    """`unit` and `tvar` (dense numbers from 1), `trel` (event time) and `treat`, on from
    `lead` periods before the first treatment period."""
    out = group_id(group_id(panel, person, "unit"), period, "tvar")
    out = out.withColumn("trel", event_time(period, first))
    return out.withColumn("treat", as_flag(F.col("trel") >= -lead))
