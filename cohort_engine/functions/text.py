"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .missing import ColumnLike, as_column

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
LETTER_PATTERN = "[A-Za-z]"


def split_key(col: ColumnLike, n: int, sep: str = "-") -> Column:
    """n-th part (from 1) of a separated key; null when there is no such part."""
    part = F.try_element_at(F.split(as_column(col), re.escape(sep)), F.lit(n))
    return F.nullif(part, F.lit(""))


def _words(col: ColumnLike) -> Column:
    return F.split(F.trim(as_column(col)), r"\s+")


def nth_word(col: ColumnLike, n: int) -> Column:
    return F.nullif(F.try_element_at(_words(col), F.lit(n)), F.lit(""))


def word_count(col: ColumnLike) -> Column:
    text = as_column(col)
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(0)).otherwise(F.size(_words(text)))


def has_letters(col: ColumnLike) -> Column:
    """Any ASCII letter; false for a missing text."""
    return F.coalesce(as_column(col).rlike(LETTER_PATTERN), F.lit(False))


def to_text(col: ColumnLike, pad: int | None = None) -> Column:
    text = as_column(col).cast("string")
    return text if pad is None else F.lpad(text, pad, "0")


def to_number(col: ColumnLike, force: bool = True, kind: str = "double") -> Column:
    """Text to number. With `force`, unreadable text becomes missing; without it the
    query fails on the first such value. Blank text and a lone "." are missing."""
    text = as_column(col).cast("string")
    blank = text.isNull() | F.trim(text).isin("", ".")
    # a bare try_cast reads '12d' as 12.0, hence the pattern in front of it
    number = F.trim(text).try_cast("double").try_cast(kind)
    reject = F.lit(None) if force else F.raise_error(F.concat(F.lit("not a number: "), text))
    return (F.when(blank, F.lit(None)).when(text.rlike(NUMBER_PATTERN), number)
            .otherwise(reject.cast(kind)))


def null_marker(col: ColumnLike, markers: Iterable[str] = ("", "NULL", "Unknown")) -> Column:
    """Marker texts (after trimming) to null."""
    text = as_column(col)
    return F.when(F.trim(text).isin(*markers), F.lit(None)).otherwise(text)


def recode(col: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; others stay. `mapping` is written by hand, so short."""
    source = as_column(col)
    targets: dict[str, list[str]] = {}
    for raw, canonical in mapping.items():
        targets.setdefault(canonical, []).append(raw)
    out = source
    for canonical, raws in targets.items():
        out = F.when(source.isin(*raws), F.lit(canonical)).otherwise(out)
    return out


def join_text(sep: str, *cols: ColumnLike) -> Column:
    return F.concat_ws(sep, *[as_column(c) for c in cols])


def code_list(col: ColumnLike, sep: str = "/") -> Column:
    """A joined cell as an array of its codes; a missing or blank cell is one null."""
    text = F.trim(F.replace(as_column(col), F.lit(sep), F.lit(" ")))
    return (F.when(text.isNull() | (text == ""), F.array(F.lit(None).cast("string")))
            .otherwise(F.split(text, r"\s+")))
