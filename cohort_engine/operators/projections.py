"""Column selection, renaming and derivation over whole frames."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import as_flag, truth
from ..functions.text import code_list, null_marker
from .keys import as_list, attach
from .ordering import global_index


def cols(df: DataFrame, prefix: str = "", suffix: str = "", like: str = "*") -> list[str]:
    """Names that start with, end with and match (`*`, `?`) the given patterns."""
    return [c for c in df.columns
            if c.startswith(prefix) and c.endswith(suffix) and fnmatch.fnmatchcase(c, like)]


def keep_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; naming one that does not exist is an error."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    return df.drop(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def add_suffix(df: DataFrame, names: Iterable[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({n: n + suffix for n in names})


def order_cols(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def map_cols(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column],
             out: Callable[[str], str] = lambda n: n) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    return df.withColumns({out(n): fn(F.col(n)) for n in names})


def replace_if(df: DataFrame, col: str, value: Any, cond: Column) -> DataFrame:
    """Set `col` to `value` where `cond` holds; an unknown condition leaves it."""
    value = value if isinstance(value, Column) else F.lit(value)
    old = F.col(col) if col in df.columns else F.lit(None)
    return df.withColumn(col, F.when(truth(cond), value).otherwise(old))


def zero_fill(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return map_cols(df, names, lambda c: F.coalesce(c, F.lit(0)))


def null_markers(df: DataFrame, names: Iterable[str],
                 markers: Sequence[str] = ("", "NULL", "Unknown")) -> DataFrame:
    return map_cols(df, names, lambda c: null_marker(c, markers))


def indicators(df: DataFrame, col: str, values: Iterable[Any], prefix: str,
               names: Mapping[Any, str] | None = None) -> DataFrame:
    """One 0/1 column per listed value."""
    names = names or {}
    return df.withColumns({prefix + str(names.get(v, v)): as_flag(F.col(col) == F.lit(v))
                           for v in values})


def set_flags(code: Column, code_sets: Mapping[str, Sequence[Any]]) -> dict[str, Column]:
    """0/1 expression per set. An item of a set is a code or a `(low, high)` range."""
    out = {}
    for name, items in code_sets.items():
        singles = [i for i in items if not isinstance(i, tuple)]
        tests = [code.between(lo, hi) for lo, hi in (i for i in items if isinstance(i, tuple))]
        if singles:
            tests.append(code.isin(*singles))
        cond = tests[0]
        for test in tests[1:]:
            cond = cond | test
        out[name] = as_flag(cond)
    return out


def code_flags(df: DataFrame, code: str, code_sets: Mapping[str, Sequence[Any]],
               prefix: str = "") -> DataFrame:
    """Membership flags for sets that may overlap, so a code can raise several."""
    flags = set_flags(F.col(code), code_sets)
    return df.withColumns({prefix + name: flag for name, flag in flags.items()})


def explode_codes(df: DataFrame, col: str, sep: str = "/") -> DataFrame:
    """One row per code of a joined cell; a missing cell keeps its one row."""
    return df.withColumn(col, F.explode(code_list(col, sep)))


def expand_rows(df: DataFrame, n: Column | str, index: str = "copy") -> DataFrame:
    """Repeat each row n times with a copy number from 1; n below 1 or missing keeps one."""
    times = F.col(n) if isinstance(n, str) else n
    times = F.greatest(F.coalesce(times.cast("int"), F.lit(1)), F.lit(1))
    return df.withColumn(index, F.explode(F.sequence(F.lit(1), times)))


def group_id(df: DataFrame, by: str | Sequence[str], out: str = "id") -> DataFrame:
    """Dense number from 1 of the sorted distinct keys. A row with a missing key part
    belongs to no group and gets no number."""
    by = as_list(by)
    keys = df.select(*by).distinct()
    for k in by:
        keys = keys.filter(F.col(k).isNotNull())
    numbered = global_index(keys, by, out="__gid")
    numbered = numbered.select(*by, (F.col("__gid") + 1).alias(out))
    return attach(df, numbered, by, null_safe=False)


def encode(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Integer code of a text column in alphabetical order, and the labels as a table of `out`
    and `col`. Missing texts have no code."""
    labels = global_index(df.select(col).filter(F.col(col).isNotNull()).distinct(), col, out="__code")
    labels = labels.select((F.col("__code") + 1).cast("int").alias(out), col)
    return attach(df, labels, col, null_safe=False), labels
