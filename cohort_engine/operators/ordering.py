"""Sorting, global numbering and exact order statistics without one big partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .keys import as_list, attach

SLICES = 256  # of an order, at most; a power of two
SAMPLE_ROWS = 20 * SLICES  # rows that the cuts are chosen from, about


def nulls_last(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def sort_rows(df: DataFrame, order: str | Sequence[str | Column]) -> DataFrame:
    """Sort with missing values last."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*nulls_last(order))


def first_rows(df: DataFrame, k: int, order: str | Sequence[str]) -> DataFrame:
    return sort_rows(df, order).limit(k)


def place(order: Sequence[str]) -> Column:
    """A row's place in an order with missing values last, as one value to compare."""
    return F.struct(*[x for i, o in enumerate(order) for x in (F.col(o).isNull().alias(f"n{i}"), F.col(o).alias(f"v{i}"))])


class Slices:
    """A frame cut into at most SLICES slices of a total order.

    The cuts come from a sample and are stored in the plan as literals, so a row's slice is a
    function of its values: rows themselves are never stored, and every pass over the frame, in whatever
    partitions, finds the same slices. A pass that counts per slice gives each slice what lies before
    it. `by` names the first columns of the order if rows are to be placed within groups.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], by: Sequence[str] = ()):
        self.order = [*by, *order]
        share = min(1.0, SAMPLE_ROWS / max(1, df.count()))
        spot, group = place(self.order), F.xxhash64(*[F.col(b) for b in by]) if by else F.lit(0).cast("long")
        some = df.filter(F.rand(11) < share).agg(F.sort_array(F.collect_list(F.struct(spot.alias("p"), group.alias("g")))).alias("a"))
        picked = F.expr(f"array_distinct(transform(sequence(1, {SLICES - 1}), i -> a[cast(i * size(a) div {SLICES} as int)]))")
        chosen = some.select(F.when(F.size("a") > 0, picked).otherwise(F.slice("a", 1, 0)).alias("c"))
        kind = chosen.schema["c"].dataType.elementType["p"].dataType
        row = chosen.select(F.to_json("c.p").alias("p"), "c.g").first()
        self.groups, self.n = row["g"], len(row["g"])
        cuts = F.from_json(F.lit(row["p"]), T.ArrayType(kind))
        # binary search, in columns that follow each other: all of it is compiled, and a row is compared eight times
        rows, step = df.withColumns({"__place": spot, "__group": group, "__slice": F.lit(0)}), SLICES // 2
        while step:
            beyond = F.coalesce(F.get(cuts, F.col("__slice") + (step - 1)) <= F.col("__place"), F.lit(False))
            rows = rows.withColumn("__slice", F.col("__slice") + F.when(beyond, step).otherwise(0))
            step //= 2
        self.df = rows

    def in_group_of(self, number: Column) -> Column:
        """Whether a row is in the group in which cut `number` falls."""
        return F.coalesce(F.col("__group") == F.get(F.lit(self.groups or [0]), number), F.lit(False))

    def totals(self, **aggregates: Column) -> dict[str, list]:
        """Aggregates per slice, in the order of slices; 0 where there is no row."""
        out = {name: [0] * (SLICES + 1) for name in aggregates}
        for row in self.df.groupBy("__slice").agg(*[a.alias(n) for n, a in aggregates.items()]).collect():
            for name in aggregates:
                out[name][row["__slice"]] = row[name] or 0
        return out

    def window(self, *by: str):
        return W.partitionBy("__slice", *by).orderBy(*nulls_last(self.order))

    def done(self) -> list[str]:
        return ["__place", "__group", "__slice"]


def _before(totals: list) -> Column:
    """What lies before a row's slice."""
    starts = [0]
    for x in totals[:-1]:
        starts.append(starts[-1] + x)
    return F.get(F.lit(starts), F.col("__slice"))


def global_index(df: DataFrame, order: str | Sequence[str], out: str = "index") -> DataFrame:
    """Row number from 0 in the total order given, over the whole frame.

    Rows are shuffled once, by slice, and numbered there. `df` is read three times (for its size and the
    cuts, for the rows per slice, for the result): store it first if it is costly.
    """
    slices = Slices(df, as_list(order))
    before = _before(slices.totals(n=F.count(F.lit(1)))["n"])
    return slices.df.withColumn(out, (before + F.row_number().over(slices.window()) - 1).cast("bigint")).drop(*slices.done())


def group_index(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], out: str = "index") -> DataFrame:
    """Row number from 1 in each group, in a total order of its rows.

    Rows are numbered within group and slice, so a hot group is dealt to as many tasks as it has
    slices. Only the group in which a slice begins can have rows in slices before it; the pass that counts per
    slice counts the rows of that group, and of the one in which the slice ends.
    """
    slices = Slices(df, as_list(order), as_list(by))
    here, number = slices.in_group_of, F.col("__slice")
    counted = slices.totals(first=F.count_if(here(number - 1)), last=F.count_if(here(number)))
    ahead = [0]
    for i in range(slices.n):  # slice i + 1 begins at cut i
        within = i and slices.groups[i - 1] == slices.groups[i]  # slice i lies in one group
        ahead.append(ahead[-1] + counted["first"][i] if within else counted["last"][i])
    begun = F.when(here(number - 1), F.get(F.lit(ahead), number)).otherwise(0)
    return slices.df.withColumn(out, (begun + F.row_number().over(slices.window(*as_list(by)))).cast("bigint")).drop(*slices.done())


def running_totals(df: DataFrame, order: str | Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Inclusive running sums in a total order over the whole frame, `{output: column}`."""
    slices = Slices(df, as_list(order))
    counted = slices.totals(**{out: F.sum(value) for out, value in totals.items()})
    upto = slices.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    return slices.df.withColumns({out: F.sum(value).over(upto) + _before(counted[out]) for out, value in totals.items()}).drop(*slices.done())


def running_total(df: DataFrame, order: str | Sequence[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of `value` in a total order over the whole frame."""
    return running_totals(df, order, {out: value})


def known(col: str, kind: T.DataType) -> Column:
    """Whether a value counts: it is not missing, nor NaN, which counts as missing."""
    value = F.col(col)
    return value.isNotNull() & ~F.isnan(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value.isNotNull()


def group_percentiles(df: DataFrame, by: str | Sequence[str], col: str, percents: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """`by`, `percent`, `n` (known values), `low`, `high` per group and percent: exact values, in the
    column's own type, at the two ranks whose mean is the percentile (n * percent / 100 and the
    next if that is whole, else the next whole rank twice). Nothing runs before the result is used.

    One aggregate brackets each percentile of each group: two approximate percentiles (error n / accuracy) with it
    in between. A second counts each row by value where it lies in a bracket, and with all others
    below the same bracket where it does not, so that a few rows in `accuracy` are left of any group
    and running sums over them give ranks. Groups of up to 4 * accuracy values are a bracket as a whole.
    """
    by, percents = as_list(by), sorted(percents)
    value, d = F.col("__v"), F.col("__v").cast("double")
    rows = df.filter(known(col, df.schema[col].dataType)).select(*by, F.col(col).alias("__v"))
    slack = 2.0 / accuracy
    points = [min(1.0, max(0.0, p / 100 + s)) for p in percents for s in (-slack, slack)]
    near = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("least"), F.max(d).alias("most"),
                                 F.percentile_approx(d, points, accuracy).alias("at"))

    def bracket(i: int, p: float) -> Column:
        share, few = F.col("n") * F.lit(p) / 100, F.col("n") < 4 * accuracy
        whole = F.abs(share - F.round(share)) < 1e-9
        rank = F.greatest(F.lit(1), F.least(F.col("n"), F.when(whole, F.round(share)).otherwise(F.ceil(share)).cast("bigint")))
        nth = F.when(whole & (F.round(share) >= 1) & (rank < F.col("n")), rank + 1).otherwise(rank)
        return F.struct(F.lit(float(p)).alias("percent"), rank.alias("rank"), nth.alias("next"),
                        F.when(few, F.col("least")).otherwise(F.get("at", F.lit(2 * i))).alias("lo"),
                        F.when(few, F.col("most")).otherwise(F.get("at", F.lit(2 * i + 1))).alias("hi"))

    near = near.select(*by, "n", F.array(*[bracket(i, p) for i, p in enumerate(percents)]).alias("b"))
    inside = F.exists("b", lambda b: (b["lo"] <= d) & (d <= b["hi"]))
    above = F.array_min(F.transform(F.filter("b", lambda b: b["lo"] > d), lambda b: b["lo"]))
    counted = (attach(rows, near.drop("n"), by, "inner").withColumn("in", inside)
               .select(*by, F.when(F.col("in"), d).otherwise(above).alias("edge"), "in", F.when(F.col("in"), value).alias("x"))
               .filter(F.col("edge").isNotNull()).groupBy(*by, "edge", "in", "x").agg(F.count(F.lit(1)).alias("c")))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy("edge", "in", "x").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counted.withColumn("upto", upto).filter("in").select(*by, "edge", "x", "upto")
    each = attach(ranked, near, by, "inner").select(*by, "n", "edge", "x", "upto", F.explode("b").alias("t")).filter("t.lo <= edge AND edge <= t.hi")
    return each.groupBy(*by, F.col("t.percent").alias("percent")).agg(
        F.first("n").alias("n"), F.min(F.when(F.col("upto") >= F.col("t.rank"), F.col("x"))).alias("low"),
        F.min(F.when(F.col("upto") >= F.col("t.next"), F.col("x"))).alias("high"))


def middle(low: Column, high: Column) -> Column:
    """The mean of two values as a double. Of equal ones it is their value."""
    return F.when(low == high, low.cast("double")).otherwise((low.cast("double") + high.cast("double")) / 2)


def percentiles(df: DataFrame, col: str, percents: Sequence[float]) -> dict[float, Any]:
    """Exact percentiles of the known values of a column, by the averaging rule above."""
    rows = group_percentiles(df.withColumn("__all", F.lit(0)), "__all", col, percents).collect()
    found = {r["percent"]: r["low"] if r["low"] == r["high"] else (r["low"] + r["high"]) / 2 for r in rows}
    return {p: found.get(float(p)) for p in percents}


def xtile(df: DataFrame, col: str, n: int, out: str, cuts_from: DataFrame | None = None) -> DataFrame:
    """Quantile class 1..n by value: ties stay together, missing (and NaN) stays missing.

    A value is above a cut if it is above the lower of the two values whose mean the cut is, as none lies in
    between; so it is compared in its own type. The cuts are a scalar subquery. They come
    from `cuts_from`, if given: the same rows, stored and with fewer columns.
    """
    rows = (df if cuts_from is None else cuts_from).withColumn("__all", F.lit(0))
    cuts = group_percentiles(rows, "__all", col, [100 * i / n for i in range(1, n)]).agg(F.collect_list("low")).scalar()
    number = F.lit(1)
    for i in range(n - 1):
        number = number + F.coalesce((F.col(col) > F.get(cuts, F.lit(i))).cast("int"), F.lit(0))
    return df.withColumn(out, F.when(known(col, df.schema[col].dataType), number).cast("int"))


def ntile_by(df: DataFrame, col: str, n: int, tie_break: Sequence[str], out: str) -> DataFrame:
    """Rank class 1..n: equal-sized classes, larger ones first, ties split by
    `tie_break` (which must complete the order); missing stays missing."""
    order = [col, *as_list(tie_break)]
    slices = Slices(df, order)
    counted = slices.totals(n=F.count(F.lit(1)), known=F.count(col))
    base, extra = divmod(sum(counted["known"]), n)
    rank = _before(counted["n"]) + F.row_number().over(slices.window()) - 1  # missing values are last, so they shift none
    wide = extra * (base + 1)  # rows in the classes that hold one more
    tile = F.when(rank < wide, F.floor(rank / (base + 1)) + 1).otherwise(F.floor((rank - wide) / max(base, 1)) + extra + 1)
    return slices.df.withColumn(out, F.when(F.col(col).isNotNull(), tile).cast("int")).drop(*slices.done())
