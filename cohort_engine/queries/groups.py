"""Queries for aggregation, deduplication, summaries and per-group positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..operators import collapse as C, ordering as O, windows as W
from .base import Tables, query, rounded, sql_quarter, text


@query("""
SELECT l_suppkey, round(coalesce(sum(nullif(l_discount, 0.05)), 0), 2) AS discount,
  round(coalesce(sum(CASE WHEN l_returnflag = 'R' AND l_suppkey > 50 THEN l_quantity END), 0), 2) AS returned
FROM lineitem GROUP BY 1""")
def collapsed_sums(t: Tables) -> DataFrame:
    """Sums by group; an all-missing group sums to 0 (A1)."""
    df = t.lineitem.select("l_suppkey", F.nullif("l_discount", F.lit(0.05)).alias("discount"),
                           F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") > 50), F.col("l_quantity")).alias("returned"))
    out = C.collapse_sum(df, "l_suppkey", ["discount", "returned"])
    return out.select("l_suppkey", F.round("discount", 2).alias("discount"), F.round("returned", 2).alias("returned"))


@query(f"""
SELECT o_custkey, {sql_quarter('o_orderdate')} AS q, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS price
FROM orders GROUP BY ALL""")
def month_then_quarter(t: Tables) -> DataFrame:
    """Sums by month, then by quarter from the months (A2)."""
    df = t.orders.select("o_custkey", D.month_index("o_orderdate").alias("m"), F.lit(1).alias("n"), F.col("o_totalprice").alias("price"))
    out = C.rollup_periods(df, "o_custkey", "m", ["n", "price"])
    return out.select("o_custkey", "q", "n", F.round("price", 2).alias("price"))


@query("""
SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts,
  CAST(count(DISTINCT flag) + max(CASE WHEN flag IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_flags
FROM (SELECT l_suppkey, l_partkey, nullif(l_returnflag, 'N') AS flag FROM lineitem) GROUP BY 1""")
def distinct_entities(t: Tables) -> DataFrame:
    """Different entities per group; missing counts as one (A3)."""
    df = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return C.n_distinct(df, "l_suppkey", {"n_parts": "l_partkey", "n_flags": "flag"})


@query("""
SELECT o_custkey, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS urgent_done,
  CAST(max(CASE WHEN nullif(o_orderstatus, 'P') = 'O' AND o_totalprice > 480000 THEN 1 ELSE 0 END) AS INTEGER) AS large_open
FROM orders GROUP BY 1""")
def any_flags(t: Tables) -> DataFrame:
    """1 where any row of the person meets the condition, else 0 (A4)."""
    return C.any_by(t.orders, "o_custkey", {
        "urgent_done": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"),
        "large_open": (F.nullif("o_orderstatus", F.lit("P")) == "O") & (F.col("o_totalprice") > 480000)})


@query("""
SELECT o_custkey, strftime(min(o_orderdate) FILTER (o_orderpriority = '1-URGENT'), '%Y-%m-%d') AS first_urgent,
  strftime(min(o_orderdate) FILTER (o_totalprice > 490000), '%Y-%m-%d') AS first_large
FROM orders GROUP BY 1""")
def first_dates(t: Tables) -> DataFrame:
    """Earliest date of the rows meeting each condition (A5)."""
    df = C.first_date_by(t.orders.withColumn("day", D.to_day("o_orderdate")), "o_custkey", {
        "first_urgent": F.col("o_orderpriority") == "1-URGENT", "first_large": F.col("o_totalprice") > 490000}, "day")
    return df.select("o_custkey", text("first_urgent").alias("first_urgent"), text("first_large").alias("first_large"))


@query("SELECT l_suppkey, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def rows_in_group(t: Tables) -> DataFrame:
    """Rows per group."""
    return C.count_by(t.lineitem, ["l_suppkey", "l_linestatus"])


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_keys
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def unique_keys(t: Tables) -> DataFrame:
    """Rows and different keys under a condition."""
    return C.unique_report(t.orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT")


@query("""
WITH c AS (SELECT p_size, count(*) AS freq FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)
SELECT p_size, CAST(freq AS BIGINT) AS freq, round(100.0 * freq / sum(freq) OVER (), 6) AS percent,
  round(100.0 * sum(freq) OVER (ORDER BY p_size) / sum(freq) OVER (), 6) AS cum_percent FROM c""")
def frequency_table(t: Tables) -> DataFrame:
    """Count, percent and cumulative percent of each value."""
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = C.freq_table(df, "p_size")
    return out.select("p_size", "freq", rounded("percent").alias("percent"), rounded("cum_percent").alias("cum_percent"))


@query("""
SELECT CAST(count(l_quantity) AS BIGINT) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
  min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem WHERE l_returnflag = 'R'""")
def summary(t: Tables) -> DataFrame:
    """Count, mean, deviation and range under a condition."""
    df = C.summarize(t.lineitem, "l_quantity", F.col("l_returnflag") == "R")
    return df.select("n", rounded("mean").alias("mean"), rounded("sd").alias("sd"), "min", "max")


def sql_percentile(p: int) -> str:
    """Value at rank n*p/100: the mean of that and the next when whole, else the next."""
    return (f"(SELECT avg(v) FROM r WHERE rn IN (CASE WHEN (n * {p}) % 100 = 0 THEN (n * {p}) // 100 ELSE (n * {p}) // 100 + 1 END,"
            f" (n * {p}) // 100 + 1))")


DETAIL_SQL = """
WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT count(v) AS n, avg(v) AS mean, var_samp(v) AS variance, stddev_samp(v) AS sd, sum(v) AS total FROM r),
k AS (SELECT sum(power(v - mean, 2)) / count(*) AS m2, sum(power(v - mean, 3)) / count(*) AS m3, sum(power(v - mean, 4)) / count(*) AS m4 FROM r, m)
SELECT 'n' AS stat, round(CAST(n AS DOUBLE), 4) AS value FROM m UNION ALL SELECT 'sum', round(total, 2) FROM m
UNION ALL SELECT 'mean', round(mean, 4) FROM m UNION ALL SELECT 'sd', round(sd, 4) FROM m
UNION ALL SELECT 'variance', round(variance, 0) FROM m
UNION ALL SELECT 'skewness', round(m3 / power(m2, 1.5), 4) FROM k UNION ALL SELECT 'kurtosis', round(m4 / (m2 * m2), 4) FROM k
""" + " ".join(f"UNION ALL SELECT 'p{p}', round({sql_percentile(p)}, 4) FROM (SELECT 1)" for p in C.DETAIL_PERCENTS) + """
UNION ALL SELECT concat('smallest_', rn), round(v, 4) FROM r WHERE rn <= 4
UNION ALL SELECT concat('largest_', n - rn + 1), round(v, 4) FROM r WHERE rn > n - 4"""


@query(DETAIL_SQL)
def detailed_summary(t: Tables) -> DataFrame:
    """Percentiles, moments and extreme values (A10)."""
    df = C.summarize_detail(t.orders, "o_totalprice", F.col("o_orderstatus") == "F")
    places = F.when(F.col("stat") == "sum", F.round("value", 2)).when(F.col("stat") == "variance", F.round("value", 0))
    return df.select("stat", places.otherwise(F.round("value", 4)).alias("value"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 2) AS l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def deduplicated(t: Tables) -> DataFrame:
    """One whole row per key, by a stated order."""
    df = C.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity", 2).alias("l_quantity"))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey) AS BIGINT) AS seq
FROM orders""")
def sequence_in_group(t: Tables) -> DataFrame:
    """Number of each row in its group by date, missing dates last."""
    df = t.orders.withColumn("day", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return W.seq_in_group(df, "o_custkey", ["day", "o_orderkey"]).select("o_orderkey", "seq")


@query("""
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_of_group(t: Tables) -> DataFrame:
    """First row of each group."""
    return W.first_in_group(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS INTEGER) AS first FROM events""")
def first_occurrence(t: Tables) -> DataFrame:
    """Indicator of the first row of each group on every row."""
    return W.first_flag(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "first")


@query("""
SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey, nullif(c_mktsegment, 'BUILDING')) AS BIGINT) AS n FROM customer""")
def sizes_on_rows(t: Tables) -> DataFrame:
    """Group size on every row; missing keys are one group."""
    df = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return W.group_size(df, ["c_nationkey", "segment"]).select("c_custkey", "n")


@query("""
SELECT o_orderkey, round(min(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS low,
  round(max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice END) OVER (PARTITION BY o_custkey), 2) AS high
FROM orders""")
def statistics_on_rows(t: Tables) -> DataFrame:
    """Group minimum and conditional maximum on every row; none is missing."""
    high = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_totalprice"))
    df = W.group_stats(t.orders, "o_custkey", {"low": F.min("o_totalprice"), "high": F.max(high)}, null_safe=False)
    return df.select("o_orderkey", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


NTH = {"view_1": ("view", 1), "view_2": ("view", 2), "view_3": ("view", 3), "buy_1": ("purchase", 1), "buy_2": ("purchase", 2)}


@query("""
WITH s AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE)) AS seq FROM events)
SELECT user_id, """ + ", ".join(
    f"strftime(min(d) FILTER (event_type = '{v}' AND seq = {n}), '%Y-%m-%d') AS {o}" for o, (v, n) in NTH.items())
    + " FROM s GROUP BY 1")
def nth_dates(t: Tables) -> DataFrame:
    """n-th date of each status, one row per person."""
    df = W.nth_dates(t.events.withColumn("day", D.to_day("ts")), "user_id", "day", NTH, status="event_type")
    return df.select("user_id", *[text(c).alias(c) for c in NTH])


@query("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x, round(o_totalprice / 50000) AS y FROM orders),
  c AS (SELECT quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM v)
SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN CAST(1 + (x > cx)::INTEGER AS INTEGER) END AS half,
  CAST(1 + (y > cy)::INTEGER AS INTEGER) AS half_ties FROM v, c""")
def value_halves(t: Tables) -> DataFrame:
    """Quantile classes by value: ties stay together, missing stays missing."""
    df = t.orders.withColumns({"x": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), "y": F.round(F.col("o_totalprice") / 50000)})
    return O.xtile(O.xtile(df, "x", 2, "half"), "y", 2, "half_ties").select("o_orderkey", "half", "half_ties")


@query("""
WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 100) END AS x FROM customer)
SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY x, c_custkey) AS INTEGER) AS tile FROM v WHERE x IS NOT NULL
UNION ALL SELECT c_custkey, NULL FROM v WHERE x IS NULL""")
def rank_tiles(t: Tables) -> DataFrame:
    """Rank classes of equal size, ties split, missing stays missing."""
    df = t.customer.withColumn("x", F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 100)))
    return O.ntile_by(df, "x", 7, ["c_custkey"], "tile").select("c_custkey", "tile")
