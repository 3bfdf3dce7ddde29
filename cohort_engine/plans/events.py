"""Event tables to counts per person and period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import month_index
from ..functions.missing import as_flag
from ..functions.text import has_letters, to_number
from ..operators.collapse import distinct_count, rollup_periods
from ..operators.filters import in_window
from ..operators.merge import map_to_person
from ..operators.projections import explode_codes, set_flags


def sample_map(patient: DataFrame, sample: DataFrame, site_key: str, person: str,
               columns: Sequence[str] = ()) -> DataFrame:
    """Site key to person for the sampled persons only. Events then need one join, with
    the two person tables already joined to each other."""
    return map_to_person(patient.select(site_key, person), sample.select(person, *columns), person,
                         list(columns) or [person]).filter(F.col(site_key).isNotNull())


def dated(events: DataFrame, when: str, window: tuple[int, int] | None, month: str = "month") -> DataFrame:
    """Events of the window with their month number. On a date or timestamp column the
    window is applied as day bounds, which the reader can use to skip data; a column of
    month numbers is filtered as it is."""
    rows = in_window(events, when, *window) if window else events
    kind = events.schema[when].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return rows.withColumn(month, month_index(when))
    return rows.withColumn(month, F.col(when))


def clean_codes(events: DataFrame, code: str, code_range: tuple[int, int], sep: str = "/",
                out: str = "code_num") -> DataFrame:
    """Drop codes holding letters and the code 0, split joined codes into rows, read them
    as numbers and keep those in range. Missing codes drop out with the range."""
    rows = events.filter(~has_letters(code))
    rows = rows.filter(~F.coalesce(to_number(code) == 0, F.lit(False)))
    rows = explode_codes(rows, code, sep).withColumn(out, to_number(code, kind="int"))
    return rows.filter(F.col(out).between(*code_range))


def clean_events(events: DataFrame, people: DataFrame, site_key: str, person: str | Sequence[str],
                 code: str, when: str, window: tuple[int, int], code_range: tuple[int, int],
                 sep: str = "/") -> DataFrame:
    """Events in the window of mapped persons, one row per valid code, with their month.

    Row filters run before the join; codes are split after it, so that the join moves
    the unsplit rows.
    """
    rows = dated(events, when, window).filter(~has_letters(code))
    return clean_codes(map_to_person(rows, people, site_key, person), code, code_range, sep)


def event_counts(events: DataFrame, by: Sequence[str], code: str,
                 code_sets: Mapping[str, Sequence], entities: Mapping[str, str]) -> DataFrame:
    """Per group: how many events fall in each code set, and how many different entities
    (practices, providers) occur, a missing entity counting as one.

    A first aggregate over (group, entities) carries the sums, so a hot group is spread
    over its entities, and the distinct counts read one row per combination.
    """
    names = list(code_sets)
    flags = set_flags(F.col(code), code_sets)
    fine = events.groupBy(*by, *entities.values()).agg(*[F.sum(f).alias(n) for n, f in flags.items()])
    return fine.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
                                 *[distinct_count(c).alias(o) for o, c in entities.items()])


def category_counts(events: DataFrame, people: DataFrame, site_key: str, person: str, when: str,
                    tests: Mapping[str, Column], window: tuple[int, int] | None = None,
                    quarter: str = "q") -> DataFrame:
    """Counts of events meeting each test per person and quarter, by way of months.

    Events are summed per site key and month before the join to persons, which then
    moves one row per key and month instead of one per event.
    """
    names = list(tests)
    brief = dated(events, when, window).groupBy(site_key, "month").agg(*[F.sum(as_flag(t)).alias(n) for n, t in tests.items()])
    mapped = map_to_person(brief, people, site_key, person)
    return rollup_periods(mapped, person, "month", names, quarter)


def any_class_count(events: DataFrame, people: DataFrame, site_key: str, person: str, when: str,
                    letter: Column, letters: Sequence[str], out: str = "pres_any",
                    window: tuple[int, int] | None = None, quarter: str = "q") -> DataFrame:
    """Events in the listed classes per person and quarter (0 for a quarter that only
    has other classes)."""
    return category_counts(events, people, site_key, person, when, {out: letter.isin(*letters)},
                           window, quarter)
