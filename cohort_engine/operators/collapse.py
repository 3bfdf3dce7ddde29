"""Aggregation by group, deduplication and summaries.

Everything here is a hash or sort aggregate with a partial step on the map side, so a
group of any size is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import quarter_of_month
from ..functions.missing import as_flag
from ..session import stable
from .keys import as_list
from .ordering import group_percentiles, known, middle, nulls_last, running_total


def collapse_sum(df: DataFrame, by: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sums by group; a group of only missing values sums to 0."""
    return df.groupBy(*as_list(by)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])


def rollup_periods(df: DataFrame, by: str | Sequence[str], month: str, cols: Sequence[str],
                   quarter: str = "q") -> DataFrame:
    """Sums by month, then the quarter sums of those."""
    by = as_list(by)
    monthly = collapse_sum(df, [*by, month], cols)
    return collapse_sum(monthly.withColumn(quarter, quarter_of_month(month)), [*by, quarter], cols)


def distinct_count(entity: Column | str) -> Column:
    """Aggregate: number of different values, all missing values counting as one."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return F.count_distinct(entity) + F.coalesce(F.max(as_flag(entity.isNull())), F.lit(0))


def n_distinct(df: DataFrame, by: str | Sequence[str], entities: Mapping[str, str]) -> DataFrame:
    """Different entities per group, `{output: column}`."""
    return df.groupBy(*as_list(by)).agg(*[distinct_count(c).alias(o) for o, c in entities.items()])


def entity_sets(df: DataFrame, by: str | Sequence[str], number: str) -> DataFrame:
    """The different entities of each group as sets that can be merged: `by`, `bucket`, `members`, `missing`.

    Entities are dense numbers (see `group_id`). A row holds those of one range of 32,768 numbers as a
    bitmap of 4 KB, so a group of any size is spread over rows of fixed size, and what is
    shuffled is bitmaps and not events. `missing` says whether an entity was missing.
    """
    n = F.col(number)
    return df.groupBy(*as_list(by), F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("members"), F.max(as_flag(n.isNull())).alias("missing"))


def merge_sets(sets: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Unions of the sets of `entity_sets` by coarser groups."""
    return sets.groupBy(*as_list(by), "bucket").agg(F.bitmap_or_agg("members").alias("members"), F.max("missing").alias("missing"))


def set_sizes(sets: DataFrame, by: str | Sequence[str], out: str = "n") -> DataFrame:
    """How many different entities each set has, all missing ones counting as one."""
    return sets.groupBy(*as_list(by)).agg((F.sum(F.bitmap_count("members")) + F.max("missing")).cast("bigint").alias(out))


def distinct_by_period(df: DataFrame, by: str | Sequence[str], month: str, number: str) -> DataFrame:
    """Different entities per group by month, quarter and year (`by`, `unit`, `period`, `n`). Events are read
    once: quarters are merged from months and years from quarters, which counts could not be."""
    by = as_list(by)
    months = entity_sets(df.withColumn("period", F.col(month)), [*by, "period"], number)
    quarters = merge_sets(months.withColumn("period", F.floor(F.col("period") / 3).cast("int")), [*by, "period"])
    years = merge_sets(quarters.withColumn("period", F.floor(F.col("period") / 4).cast("int")), [*by, "period"])
    out = None
    for unit, sets in (("month", months), ("quarter", quarters), ("year", years)):
        part = set_sizes(sets, [*by, "period"]).select(*by, F.lit(unit).alias("unit"), "period", "n")
        out = part if out is None else out.unionByName(part)
    return out


def any_by(df: DataFrame, by: str | Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """1 where any row of the group meets the condition, else 0; `{output: condition}`."""
    return df.groupBy(*as_list(by)).agg(*[F.max(as_flag(c)).alias(o) for o, c in flags.items()])


def first_date_by(df: DataFrame, by: str | Sequence[str], conds: Mapping[str, Column],
                  date: str) -> DataFrame:
    """Earliest date of the rows meeting each condition; `{output: condition}`."""
    return df.groupBy(*as_list(by)).agg(
        *[F.min(F.when(c, F.col(date))).alias(o) for o, c in conds.items()])


def count_by(df: DataFrame, by: str | Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias(out))


def unique_report(df: DataFrame, key: str, cond: Column | None = None) -> DataFrame:
    """Rows and different keys, as one row."""
    rows = df if cond is None else df.filter(cond)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), distinct_count(key).cast("bigint").alias("n_keys"))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Count, percent and cumulative percent of each value in sorted order. Missing
    values are left out of the table."""
    counts = stable(count_by(df.filter(F.col(col).isNotNull()), col, "freq"))  # a row per value
    out = running_total(counts, col, "freq", "__cum")
    total = counts.agg(F.sum("freq").cast("double")).scalar()
    return out.select(col, "freq", (100 * F.col("freq") / total).alias("percent"),
                      (100 * F.col("__cum") / total).alias("cum_percent"))


def summarize(df: DataFrame, col: str, cond: Column | None = None) -> DataFrame:
    rows = df if cond is None else df.filter(cond)
    v = F.col(col)
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                    F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))


DETAIL_PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
EXTREMES = 4  # values shown at each end


def summarize_groups(df: DataFrame, by: str | Sequence[str], col: str) -> DataFrame:
    """Percentiles, moments and the four smallest and largest values of every group, as `by`,
    `stat`, `value` (double) and `exact`: values of the column itself in its own type, so whole numbers
    beyond 2^53 keep their digits. Missing and NaN values do not count.

    All groups and statistics come from the same few aggregates and nothing runs before
    the result is used; `df` is read four times, so store it first if it is costly.
    """
    by, kind = as_list(by), df.schema[col].dataType
    rows = df.select(*by, F.when(known(col, kind), F.col(col)).alias("v"))
    v = F.col("v").cast("double")
    moments = {"n": F.count(v).cast("double"), "sum": F.sum(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "variance": F.var_samp(v),
               "skewness": F.skewness(v), "kurtosis": F.kurtosis(v) + 3}
    wide = rows.groupBy(*by).agg(*[a.alias(n) for n, a in moments.items()])
    long = wide.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, moments)), F.array(*moments))).alias("stat", "value"))
    no_value = F.lit(None).cast(kind)
    parts = group_percentiles(rows, by, "v", DETAIL_PERCENTS)
    name = F.concat(F.lit("p"), F.col("percent").cast("int").cast("string"))
    parts = parts.select(*by, name.alias("stat"), middle(F.col("low"), F.col("high")).alias("value"),
                         F.when(F.col("low") == F.col("high"), F.col("low")).alias("exact"))
    out = long.select(*by, "stat", "value", no_value.alias("exact")).unionByName(parts)
    for end, order in (("smallest", F.col("v").asc()), ("largest", F.col("v").desc())):
        w = W.partitionBy(*by).orderBy(order)
        ends = rows.filter(F.col("v").isNotNull()).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= EXTREMES)
        out = out.unionByName(ends.select(*by, F.concat(F.lit(end + "_"), F.col("i").cast("string")).alias("stat"),
                                          v.alias("value"), F.col("v").alias("exact")))
    return out


def summarize_detail(df: DataFrame, col: str, cond: Column | None = None) -> DataFrame:
    """`stat`, `value`, `exact` as in `summarize_groups`, for all rows that meet the condition. Statistics
    of no values are left out, but for their number and sum."""
    rows = (df if cond is None else df.filter(cond)).select(F.lit(0).alias("__all"), col)
    return summarize_groups(rows, "__all", col).drop("__all")


def dedupe(df: DataFrame, keys: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row of each key in the given order. `order` must be total in the
    key, or equal rows must be interchangeable. Spark limits the group to one row per
    map task before the shuffle, so a hot key costs nothing."""
    w = W.partitionBy(*as_list(keys)).orderBy(*nulls_last(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
