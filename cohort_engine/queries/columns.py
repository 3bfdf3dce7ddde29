"""Queries for column expressions: missing values, text, dates, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, missing as M, scalars as S, text as X
from ..operators import collapse, projections as P
from .base import PART_SETS, PART_SETS_SQL, Tables, query, rounded, sql_month, sql_quarter, text


@query("""
SELECT o_orderpriority,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_gt,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) >= 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_ge,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) < 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_lt,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) <= 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_le,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) > coalesce(y, CAST('infinity' AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS n_gt_cols,
  CAST(sum(CASE WHEN coalesce(x, CAST('infinity' AS DOUBLE)) <= coalesce(y, CAST('infinity' AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS n_le_cols,
  CAST(sum(CASE WHEN x IS NOT DISTINCT FROM y THEN 1 ELSE 0 END) AS BIGINT) AS n_eq_cols
FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x,
             CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(250000 AS DOUBLE) END AS y FROM orders)
GROUP BY o_orderpriority""")
def missing_comparisons(t: Tables) -> DataFrame:
    """A missing value ranks above every number."""
    df = t.orders.select(
        "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit(250000.0)).alias("y"))
    tests = {"n_gt": M.gt("x", 200000), "n_ge": M.ge("x", 200000), "n_lt": M.lt("x", 200000),
             "n_le": M.le("x", 200000), "n_gt_cols": M.gt("x", F.col("y")),
             "n_le_cols": M.le("x", F.col("y")), "n_eq_cols": M.eq("x", F.col("y"))}
    return df.groupBy("o_orderpriority").agg(*[F.sum(M.as_flag(c)).alias(n) for n, c in tests.items()])


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus AS o_orderstatus_raw, o_orderpriority AS o_orderpriority_raw
FROM orders""")
def column_patterns(t: Tables) -> DataFrame:
    """Columns picked by pattern, renamed with a suffix and put in order."""
    df = P.drop_cols(t.orders, "o_totalprice", "o_orderdate")
    df = P.add_suffix(df, [*P.cols(df, like="o_order*s"), *P.cols(df, suffix="priority")], "_raw")
    df = P.rename(df, {"o_orderkey": "key"})
    return P.order_cols(P.rename(df, {"key": "o_orderkey"}), ["o_custkey"])


@query("""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n,
  round(sum(round(l_discount * 100)), 2) AS discount_pct, round(sum(round(l_tax * 100)), 2) AS tax_pct
FROM lineitem GROUP BY ALL""")
def mapped_columns(t: Tables) -> DataFrame:
    """One expression over many columns in a single projection."""
    df = P.map_cols(t.lineitem, ["l_discount", "l_tax"], lambda c: F.round(c * 100),
                    out=lambda n: n.removeprefix("l_") + "_pct")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("discount_pct"), 2).alias("discount_pct"),
        F.round(F.sum("tax_pct"), 2).alias("tax_pct"))


@query("""
SELECT CASE WHEN o_totalprice > 400000 THEN 'X' WHEN nullif(o_orderpriority, '5-LOW') = '1-URGENT' THEN 'U'
            ELSE o_orderstatus END AS status,
  CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1""")
def replaced_values(t: Tables) -> DataFrame:
    """Conditional replacement; an unknown condition leaves the value."""
    df = t.orders.withColumn("status", F.col("o_orderstatus"))
    df = P.replace_if(df, "status", "U", F.nullif("o_orderpriority", F.lit("5-LOW")) == "1-URGENT")
    df = P.replace_if(df, "status", "X", F.col("o_totalprice") > 400000)
    return collapse.count_by(df, "status")


@query("""
SELECT l_returnflag, round(sum(coalesce(nullif(l_discount, 0), 0) + l_tax), 2) AS total,
  round(sum(nullif(l_discount, 0) + l_tax), 2) AS total_known, CAST(count(nullif(l_discount, 0)) AS BIGINT) AS n_known
FROM lineitem GROUP BY 1""")
def row_sums(t: Tables) -> DataFrame:
    """Sums across columns that ignore or propagate missing values."""
    df = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    return df.groupBy("l_returnflag").agg(
        F.round(F.sum(S.row_total("d", "l_tax")), 2).alias("total"),
        F.round(F.sum(S.row_sum("d", "l_tax")), 2).alias("total_known"), F.count("d").alias("n_known"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none",
              "5-LOW": "low"}


@query("SELECT o_custkey, " + ", ".join(
    f"CAST(count(*) FILTER (o_orderpriority = '{v}') AS BIGINT) AS is_{n}" for v, n in PRIORITIES.items())
    + " FROM orders GROUP BY 1")
def category_indicators(t: Tables) -> DataFrame:
    """One 0/1 column per category value, summed by person (P10)."""
    df = P.indicators(t.orders, "o_orderpriority", PRIORITIES, "is_", PRIORITIES)
    return collapse.collapse_sum(df, "o_custkey", P.cols(df, prefix="is_"))


@query("SELECT l_returnflag, " + ", ".join(
    f"CAST(sum(CASE WHEN {c.format(c='l_partkey')} THEN 1 ELSE 0 END) AS BIGINT) AS set_{n}"
    for n, c in PART_SETS_SQL.items())
    + ", CAST(sum(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 ELSE 0 END) AS BIGINT) AS mid_quantity"
      " FROM lineitem GROUP BY 1")
def code_set_flags(t: Tables) -> DataFrame:
    """Membership flags of overlapping code sets and a range flag."""
    df = P.code_flags(t.lineitem, "l_partkey", PART_SETS, "set_")
    df = df.withColumn("mid_quantity", S.range_flag("l_quantity", 10, 20))
    return collapse.collapse_sum(df, "l_returnflag", [*P.cols(df, prefix="set_"), "mid_quantity"])


@query("""
SELECT CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS label,
  CAST(count(*) AS BIGINT) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def labelled_values(t: Tables) -> DataFrame:
    """Value labels of a coded column; an unlisted code has none."""
    df = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    df = df.withColumn("label", S.label_values("r_name", {"ASIA": "east", "EUROPE": "west"}))
    return collapse.count_by(df, "label")


@query("""
SELECT l_orderkey, CAST(sum(code) AS BIGINT) AS code_sum, CAST(max(code) AS INTEGER) AS code_max
FROM lineitem JOIN (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS code FROM part)
  ON l_partkey = p_partkey GROUP BY 1""")
def encoded_labels(t: Tables) -> DataFrame:
    """Text to integer code in alphabetical order."""
    part, _ = P.encode(t.part.select("p_partkey", "p_type"), "p_type", "code")
    df = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return df.groupBy("l_orderkey").agg(F.sum("code").alias("code_sum"), F.max("code").alias("code_max"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE' THEN
    CAST(dense_rank() OVER (PARTITION BY c_mktsegment <> 'FURNITURE' ORDER BY c_nationkey, c_mktsegment) AS BIGINT)
  END AS group_no
FROM customer""")
def group_numbers(t: Tables) -> DataFrame:
    """Dense number of sorted key groups; missing keys get none."""
    df = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    return P.group_id(df, ["c_nationkey", "segment"], "group_no").select("c_custkey", "group_no")


@query("""
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS is_urgent
FROM orders""")
def bound_columns(t: Tables) -> DataFrame:
    """Several derived columns on the same row, in place of a positional bind."""
    return t.orders.select("o_orderkey", M.as_flag(F.col("o_orderstatus") == "F").alias("is_f"),
                           M.as_flag(F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))


@query("""
SELECT l_orderkey, round(ln(sum(l_quantity) + 0.1), 6) AS log_quantity,
  round(coalesce(nullif(max(l_discount), 0.1), -1), 6) AS first_known, round(coalesce(sum(nullif(l_tax, 0)), 0), 6) AS tax_filled
FROM lineitem GROUP BY 1""")
def logs_and_fills(t: Tables) -> DataFrame:
    """log(x + 0.1), first non-missing value and zero fill (M1-M3)."""
    df = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.nullif(F.max("l_discount"), F.lit(0.1)).alias("d"),
        F.sum(F.nullif("l_tax", F.lit(0.0))).alias("tax_filled"))
    df = P.zero_fill(df, ["tax_filled"])
    return df.select("l_orderkey", rounded(S.log_plus("q")).alias("log_quantity"),
                     rounded(M.first_non_missing("d", F.lit(-1.0))).alias("first_known"),
                     rounded("tax_filled").alias("tax_filled"))


@query("""
WITH k AS (SELECT l_orderkey, concat(l_suppkey, '-', o_custkey) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CAST(split_part(k, '-', 1) AS BIGINT) AS site, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT split_part(k, '-', 2)) AS BIGINT) AS n_persons, CAST(count(nullif(split_part(k, '-', 3), '')) AS BIGINT) AS n_third
FROM k GROUP BY 1""")
def key_parts(t: Tables) -> DataFrame:
    """Parts of a separated key; a part that is not there is missing."""
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.select(X.join_text("-", F.col("l_suppkey"), F.col("o_custkey")).alias("k"))
    return df.groupBy(X.to_number(X.split_key("k", 1), force=False, kind="bigint").alias("site")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(X.split_key("k", 2)).alias("n_persons"),
        F.count(X.split_key("k", 3)).alias("n_third"))


@query(r"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END::INTEGER AS n_words,
  lower(nullif(list_extract(string_split_regex(trim(text), '\s+'), 2), '')) AS second_word
FROM documents""")
def words(t: Tables) -> DataFrame:
    """Word count and n-th word over whole texts."""
    return t.documents.select("doc_id", X.word_count("text").alias("n_words"),
                              F.lower(X.nth_word("text", 2)).alias("second_word"))


@query("""
SELECT lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month_text, CAST(year(o_orderdate) AS VARCHAR) AS year_text,
  replace(substring(o_orderpriority, 3), ' ', '_') AS priority, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""")
def text_keys(t: Tables) -> DataFrame:
    """Numbers as padded text, substring and replace."""
    df = t.orders.select(X.to_text(F.month("o_orderdate"), 2).alias("month_text"),
                         X.to_text(F.year("o_orderdate")).alias("year_text"),
                         F.replace(F.substring("o_orderpriority", 3, 99), F.lit(" "), F.lit("_")).alias("priority"))
    return collapse.count_by(df, ["month_text", "year_text", "priority"])


@query("""
WITH c AS (SELECT p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN concat(p_partkey, 'd') WHEN 'SMALL' THEN concat(p_partkey, '/', p_size)
    WHEN 'LARGE' THEN concat(' ', p_partkey, '.5 ') WHEN 'MEDIUM' THEN '' ELSE concat('-', p_partkey, 'e1') END AS code FROM part)
SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN p_partkey + 0.5 WHEN p_type IN ('PROMO', 'SMALL', 'MEDIUM') THEN NULL
    ELSE -10.0 * p_partkey END::DOUBLE AS value
FROM c""")
def forced_numbers(t: Tables) -> DataFrame:
    """Text to number; unreadable text, such as '12d', is missing."""
    key = F.col("p_partkey").cast("string")
    code = (F.when(F.col("p_type") == "PROMO", F.concat(key, F.lit("d")))
            .when(F.col("p_type") == "SMALL", F.concat_ws("/", key, F.col("p_size")))
            .when(F.col("p_type") == "LARGE", F.concat(F.lit(" "), key, F.lit(".5 ")))
            .when(F.col("p_type") == "MEDIUM", F.lit("")).otherwise(F.concat(F.lit("-"), key, F.lit("e1"))))
    value = X.to_number(code)
    return t.part.select("p_partkey", F.when(value == 0, F.lit(0.0)).otherwise(value).alias("value"))


@query("""
SELECT o_custkey, CAST(sum(CAST(o_orderkey AS DOUBLE)) AS DOUBLE) AS key_sum FROM orders GROUP BY 1""")
def strict_numbers(t: Tables) -> DataFrame:
    """Text to number where every value must be readable."""
    df = t.orders.withColumn("key_text", X.to_text("o_orderkey"))
    return df.groupBy("o_custkey").agg(F.sum(X.to_number("key_text", force=False)).alias("key_sum"))


@query("""
WITH x AS (SELECT l_orderkey, unnest(string_split(concat(l_partkey, '/', l_suppkey), '/')) AS code FROM lineitem)
SELECT CAST(code AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders
FROM x GROUP BY 1""")
def exploded_codes(t: Tables) -> DataFrame:
    """A joined cell to one row per code."""
    df = t.lineitem.select("l_orderkey", F.concat_ws("/", "l_partkey", "l_suppkey").alias("code"))
    df = P.explode_codes(df, "code")
    return df.groupBy(F.col("code").cast("bigint").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("""
WITH x AS (SELECT CASE WHEN o_orderstatus IN ('P') THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority FROM orders)
SELECT status, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'soon' WHEN priority = '5-LOW' THEN 'late' ELSE priority END AS priority,
  CAST(count(*) AS BIGINT) AS n
FROM x GROUP BY ALL""")
def recoded_markers(t: Tables) -> DataFrame:
    """Null markers to missing, and aliases to one spelling."""
    df = P.null_markers(t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
                        ["status", "priority"], ["P", "4-NOT SPECIFIED", ""])
    df = df.withColumn("priority", X.recode("priority", {"1-URGENT": "soon", "2-HIGH": "soon", "5-LOW": "late"}))
    return collapse.count_by(df, ["status", "priority"])


@query("""
SELECT p_type, copy, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum
FROM (SELECT p_type, p_partkey, CAST(unnest(range(1, greatest(coalesce(nullif(p_size, 7) - 3, 1), 1) + 1)) AS INTEGER) AS copy FROM part)
GROUP BY ALL""")
def expanded_rows(t: Tables) -> DataFrame:
    """Each row n times with a copy number; n below 1 or missing keeps one."""
    df = P.expand_rows(t.part, F.nullif("p_size", F.lit(7)) - 3)
    return df.groupBy("p_type", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("key_sum"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_datetime,
  strftime(o_orderdate, '%Y-%m-%d') AS from_prefix, strftime(o_orderdate, '%Y-%m-%d') AS from_dmy,
  strftime(o_orderdate, '%Y-%m-%d') AS from_month_name, CAST(NULL AS VARCHAR) AS from_bad
FROM orders""")
def parsed_dates(t: Tables) -> DataFrame:
    """Dates read from four text shapes; unreadable text is missing."""
    day = F.col("o_orderdate")
    month = F.element_at(F.lit(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]), F.month(day))
    named = F.concat(F.date_format(day, "dd"), month, F.date_format(day, "yyyy"), F.lit(" 00:00:00"))
    return t.orders.select(
        "o_orderkey", text(D.to_day(D.parse_datetime(F.date_format(day, "yyyy-MM-dd HH:mm:ss")))).alias("from_datetime"),
        text(D.parse_date_prefix(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T09:30:00.000Z")))).alias("from_prefix"),
        text(D.parse_date_dmy(F.date_format(day, "d/M/yyyy"))).alias("from_dmy"),
        text(D.parse_date(named)).alias("from_month_name"),
        text(D.to_day(D.parse_datetime(F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"))))).alias("from_bad"))


@query(f"""
SELECT o_orderkey, {sql_month('o_orderdate')} AS m, {sql_quarter('o_orderdate')} AS q, CAST(year(o_orderdate) AS INTEGER) AS y,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_first, concat(year(o_orderdate), 'q', quarter(o_orderdate)) AS q_label,
  CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
  {sql_quarter('o_orderdate')} - 152 AS event_q, CAST(2025 - year(o_orderdate) AS INTEGER) AS age
FROM orders""")
def period_numbers(t: Tables) -> DataFrame:
    """Month and quarter numbers and back, day counts, event time, age."""
    day = D.to_day("o_orderdate")
    df = t.orders.withColumns({"m": D.month_index(day), "q": D.quarter_index(day), "y": F.year(day)})
    return df.select(
        "o_orderkey", "m", D.quarter_of_month("m").alias("q"), "y", text(D.month_start(D.ym("y", F.month(day)))).alias("month_first"),
        D.quarter_label("q").alias("q_label"), D.days_between(day, F.lit("1998-01-01").cast("date")).alias("days"),
        D.event_time("q", F.lit(D.yq(1998, 1))).alias("event_q"), D.age_in(2025, "y").alias("age"))
