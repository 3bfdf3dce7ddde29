"""Reports on the sample: attrition and durations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import stable
from .collapse import dedupe, distinct_count, summarize_groups
from .keys import literal_rows


class Attrition:
    """Rows and persons left after each step, counted by the very job that runs through the steps.

    `passed` is put between two steps and returns its frame with counters attached; they fill
    when a later stage is first stored, so no step is computed for its counts alone:

        steps = Attrition("person_id")
        adults = steps.passed("adults", people.filter("age >= 18"))
        sample = steps.passed("sample", stable(adults.join(index, "post_code")))
        sample.write.parquet(...)
        report = steps.table(spark)

    Spark counts the rows of the tasks that ran. Where a lost executor makes it run tasks of an
    inner stage once more, their rows count again; `attrition` counts stored frames, exactly in any case.
    """

    def __init__(self, person: str):
        self.person, self.steps = person, []

    def passed(self, name: str, df: DataFrame, person_row: Column | None = None) -> DataFrame:
        """`df`, counted under `name`. Each row is a person of its own, or, if persons have
        several rows, `person_row` holds on just one row of each (e.g. that of the first period)."""
        seen = Observation(f"{len(self.steps) + 1} {name}")
        self.steps.append((name, seen))
        rows = F.count(F.lit(1))
        return df.observe(seen, rows.alias("n_rows"), (rows if person_row is None else F.count_if(person_row)).alias("n_persons"))

    def table(self, spark: SparkSession) -> DataFrame:
        """`step`, `name`, `n_rows`, `n_persons` in the order of the steps. Waits for the jobs that run them."""
        found = [(i, name, seen.get) for i, (name, seen) in enumerate(self.steps, start=1)]
        return literal_rows(spark, [(i, name, got["n_rows"], got["n_persons"]) for i, name, got in found],
                            [("step", "int"), ("name", "string"), ("n_rows", "bigint"), ("n_persons", "bigint")])


def attrition(steps: Mapping[str, DataFrame], person: str) -> DataFrame:
    """Rows and persons left after each named step, in step order, counted in a pass over each frame;
    for stored frames, or where persons have any number of rows."""
    out = None
    for number, (name, df) in enumerate(steps.items(), start=1):
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), distinct_count(person).cast("bigint").alias("n_persons"))
        row = row.select(F.lit(number).alias("step"), F.lit(name).alias("name"), "n_rows", "n_persons")
        out = row if out is None else out.unionByName(row)
    return out


def duration_summary(panel: DataFrame, person: str, duration: str,
                     groups: Mapping[str, Column]) -> DataFrame:
    """Detailed summary of a person-level duration in each named group (`group`, `stat`, `value`, `exact`).

    A person may be in several groups. Persons are stored once, with a row for each group
    they are in, and all groups are summarised together.
    """
    inside = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda g: g.isNotNull())
    people = dedupe(panel.select(person, duration, inside.alias("__groups")), person, [duration])
    people = stable(people.select(F.explode("__groups").alias("group"), duration))
    return summarize_groups(people, "group", duration)
