"""Linking rosters to the extract in a cascade with human review."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import to_number
from ..operators.linkage import apply_review, link_cascade, normalise_keys
from ..operators.merge import append


def _whole(col: Column) -> Column:
    return to_number(col, kind="int")


# "03" and 3, or text and number, are the same key; unreadable text has no key.
DEFAULT_RULES: Mapping[str, Callable[[Column], Column]] = {
    "post_code": _whole, "yob": _whole, "mob": _whole,
    "practice_id": lambda c: F.trim(c.cast("string")), "sex": lambda c: F.trim(c),
}


def one_row_each(linked: DataFrame, person: str, order: Sequence[str]) -> DataFrame:
    """One row per person: of several, each column has its first known value by `order` and
    then by size. A person that two rosters found so keeps the columns of both."""
    def first(c: str) -> Column:
        at = F.struct(*order, F.col(c))
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)

    return linked.groupBy(person).agg(*[first(c) for c in linked.columns if c != person])


def link_rosters(rosters: Mapping[str, DataFrame], pools: Sequence[DataFrame], keys: Sequence[str],
                 rules: Mapping[str, Callable[[Column], Column]] = DEFAULT_RULES,
                 decisions: DataFrame | None = None, person: str = "person_id",
                 keep_columns: Sequence[str] = (),
                 keep_unless_refused: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Link each roster to the pools in turn; returns (linked persons, pairs to review).

    Pairs of the first pass stand. Later passes found weaker candidates: they form the
    review queue, and only those a decision keeps are added to the linked persons. For
    the rosters in `keep_unless_refused`, pairs stay unless a decision refuses them.
    """
    def typed(df: DataFrame) -> DataFrame:
        """Keys by their rules, without rows of a key that cannot be read: such text equals nothing."""
        used = {k: rules[k] for k in keys if k in rules}
        for k, rule in used.items():
            text = F.nullif(F.trim(F.col(k).cast("string")), F.lit(""))
            df = df.filter(text.isNull() | rule(F.col(k)).isNotNull())
        return normalise_keys(df, used)

    sides = [typed(p).select(*dict.fromkeys([person, *keys, *keep_columns])) for p in pools]
    linked, queue = [], []
    for name, roster in rosters.items():
        hits, _ = link_cascade(typed(roster), sides, keys)
        hits = hits.withColumn("roster", F.lit(name))
        weak = hits.filter("link_pass > 1")
        linked.append(hits.filter("link_pass = 1"))
        queue.append(weak)
        lenient = name in keep_unless_refused
        if decisions is not None:
            linked.append(apply_review(weak, decisions, person, default_keep=lenient))
        elif lenient:
            linked.append(weak)
    return append(*linked), append(*queue)
