"""Queries for reading, filtering, sorting and appending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, text as X
from ..operators import collapse, filters as FL, merge, ordering
from ..sources import tables as S
from .base import Tables, query, sql_month, sql_quarter


@query("""
SELECT l_shipmode_year AS ship_year, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity
FROM (SELECT year(l_shipdate)::INTEGER AS l_shipmode_year, l_quantity FROM lineitem) GROUP BY 1""")
def read_some_columns(t: Tables) -> DataFrame:
    """Two columns of a stored table."""
    df = S.read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_shipdate", "l_quantity"])
    return df.groupBy(F.year("l_shipdate").alias("ship_year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
WHERE rn > 7""")
def without_leading_rows(t: Tables) -> DataFrame:
    """The table without its first rows in a stated order."""
    return S.drop_leading_rows(t.orders, 7, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"""
WITH o AS (SELECT {sql_quarter('o_orderdate')} AS q FROM orders),
  s AS (SELECT CAST(unnest(range(min(q) - 1, max(q) + 2)) AS INTEGER) AS q FROM o)
SELECT s.q, CAST(count(o.q) AS BIGINT) AS n FROM s LEFT JOIN o ON s.q = o.q GROUP BY 1""")
def period_calendar(t: Tables) -> DataFrame:
    """Every quarter the orders span and one on either side, with its count."""
    o = t.orders.select(D.quarter_index(D.to_day("o_orderdate")).alias("q"))
    lo, hi = o.agg(F.min("q"), F.max("q")).first()
    counts = collapse.count_by(o, "q")
    calendar = S.period_skeleton(t.spark, lo - 1, hi + 1)
    merged = merge.merge_tables(calendar, counts, "q", "1:1", keep=(1, 3), indicator=None)
    return merged.select("q", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("""
SELECT rule, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'kept' AS rule, o_orderpriority FROM orders WHERE nullif(o_orderpriority, '5-LOW') < '3'
  UNION ALL SELECT 'dropped' AS rule, o_orderpriority FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '5-LOW') < '3', false)
  UNION ALL SELECT 'missing' AS rule, o_orderpriority FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL)
GROUP BY ALL""")
def keep_and_drop(t: Tables) -> DataFrame:
    """Keep, drop and missing tests on the same unknown condition."""
    df = t.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    parts = {"kept": FL.keep_if(df, F.col("p") < "3"), "dropped": FL.drop_if(df, F.col("p") < "3"),
             "missing": FL.keep_if(df, F.col("p").isNull())}
    stacked = merge.append(*[p.select(F.lit(n).alias("rule"), "o_orderpriority") for n, p in parts.items()])
    return collapse.count_by(stacked, ["rule", "o_orderpriority"])


@query(f"""
SELECT {sql_month('l_shipdate')} AS m, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price
FROM lineitem WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1999-10-01' GROUP BY 1""")
def month_window(t: Tables) -> DataFrame:
    """Rows of a closed range of months, filtered on the raw column (F2)."""
    df = FL.in_window(t.lineitem, "l_shipdate", D.ym(1996, 3), D.ym(1999, 9))
    return df.groupBy(D.month_index("l_shipdate").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""
SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part
WHERE p_brand IN ('Brand#3', 'Brand#8', 'Brand#17') AND p_size BETWEEN 10 AND 30 GROUP BY ALL""")
def members_and_ranges(t: Tables) -> DataFrame:
    """Set membership and numeric range."""
    df = t.part.filter(F.col("p_brand").isin("Brand#3", "Brand#8", "Brand#17") & F.col("p_size").between(10, 30))
    return collapse.count_by(df, ["p_brand", "p_size"])


@query("""
SELECT p_partkey FROM part WHERE NOT coalesce(regexp_matches(
  CASE WHEN p_type = 'PROMO' THEN concat(p_partkey, 'A') WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_partkey AS VARCHAR) END, '[A-Za-z]'), false)""")
def codes_without_letters(t: Tables) -> DataFrame:
    """Drop codes that hold a letter; a missing code stays."""
    code = (F.when(F.col("p_type") == "PROMO", F.concat("p_partkey", F.lit("A")))
            .when(F.col("p_type") == "SMALL", F.lit(None)).otherwise(F.col("p_partkey").cast("string")))
    return FL.drop_if(t.part.withColumn("code", code), X.has_letters("code")).select("p_partkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def excluded_persons(t: Tables) -> DataFrame:
    """Rows of persons not on an exclusion list."""
    listed = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return FL.exclude(t.orders, listed, "o_custkey").select("o_orderkey", "o_custkey")


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1""")
def groups_with_any(t: Tables) -> DataFrame:
    """All rows of the groups in which some row meets a condition (F8)."""
    df = FL.keep_groups_any(t.lineitem, "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH k AS (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS segment, CAST(round(c_acctbal / 500) AS BIGINT) AS band FROM customer)
SELECT c_custkey, c_nationkey, segment, band FROM k
QUALIFY count(*) OVER (PARTITION BY c_nationkey, segment, band) = 1""")
def unambiguous_keys(t: Tables) -> DataFrame:
    """Rows whose composite key occurs once, missing parts included."""
    df = t.customer.select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
                           F.round(F.col("c_acctbal") / 500).cast("bigint").alias("band"))
    return FL.keep_unique_keys(df, ["c_nationkey", "segment", "band"])


@query("""
WITH b AS (SELECT ceil(avg(c_acctbal) - 1 * stddev_samp(c_acctbal)) AS lo FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer, b WHERE c_acctbal >= lo""")
def trimmed_outliers(t: Tables) -> DataFrame:
    """Values no less than k deviations below a reference group's mean."""
    df = FL.trim_by_sd(t.customer, "c_acctbal", "c_custkey", F.col("c_mktsegment") == "BUILDING", k=1)
    return df.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {sql_quarter('o_orderdate')} AS q FROM orders),
  e AS (SELECT o_custkey, {sql_quarter('max(o_orderdate)')} AS q_end FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, q, q_end FROM o LEFT JOIN e USING (o_custkey)
WHERE (q_end IS NULL OR q < q_end) AND (q_end IS NULL OR q_end >= 150)""")
def censored_periods(t: Tables) -> DataFrame:
    """Periods before a person's end; persons who ended before the start leave."""
    ends = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        D.quarter_index(F.max("o_orderdate")).alias("q_end"))
    rows = t.orders.select("o_orderkey", "o_custkey", D.quarter_index("o_orderdate").alias("q"))
    merged = merge.lookup(rows, ends, "o_custkey", required=False)
    return FL.censor_after(merged, "q", "q_end", 150).select("o_orderkey", "q", "q_end")


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders
ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice END NULLS LAST, o_orderkey LIMIT 25""")
def first_rows(t: Tables) -> DataFrame:
    """The first rows of an order with missing values last (O1, O2)."""
    df = t.orders.withColumn("x", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return ordering.first_rows(df, 25, ["x", "o_orderkey"]).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("""
SELECT kind, nation, extra, CAST(count(*) AS BIGINT) AS n, round(sum(balance), 2) AS balance FROM (
  SELECT 'customer' AS kind, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS extra, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', CAST(s_nationkey AS BIGINT), NULL, s_acctbal FROM supplier)
GROUP BY ALL""")
def appended_tables(t: Tables) -> DataFrame:
    """Two tables appended by name after their types are aligned."""
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").cast("bigint").alias("nation"),
                          F.col("c_mktsegment").alias("extra"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("string").alias("nation"),
                          F.col("s_acctbal").alias("balance"))
    both = merge.append(a, merge.align_types(b, a))
    return both.groupBy("kind", "nation", "extra").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))
