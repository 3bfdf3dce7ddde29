"""Queries for merges, lookups, linkage keys and cross panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, text as X
from ..operators import collapse as C, linkage as L, merge as M
from .base import Tables, query, sql_quarter

# The left side holds many rows per key and missing keys, the right side one row per key
# of which one is missing.
MERGE_SIDES = """
l AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS k, 'left' AS side, round(o_totalprice, 2) AS price FROM orders),
r AS (SELECT CASE WHEN c_custkey <> 0 THEN c_custkey + 700 END AS k, c_mktsegment, 'right' AS side FROM customer)"""


def merge_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("k"),
                           F.lit("left").alias("side"), F.round("o_totalprice", 2).alias("price"))
    right = t.customer.select(F.when(F.col("c_custkey") != 0, F.col("c_custkey") + 700).alias("k"), "c_mktsegment", F.lit("right").alias("side"))
    return left, right


MERGE_FULL = """SELECT o_orderkey, coalesce(l.k, r.k) AS k, coalesce(l.side, r.side) AS side, price, c_mktsegment,
  CAST(CASE WHEN l.side IS NULL THEN 2 WHEN r.side IS NULL THEN 1 ELSE 3 END AS INTEGER) AS _merge
FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k"""


@query(f"WITH {MERGE_SIDES} {MERGE_FULL}")
def merged_with_status(t: Tables) -> DataFrame:
    """Merge with match status; missing keys match; left values win."""
    left, right = merge_sides(t)
    return M.merge_tables(left, right, "k", "m:1", validate=True)


@query(f"WITH {MERGE_SIDES} SELECT o_orderkey, k, side, price, c_mktsegment, _merge FROM ({MERGE_FULL}) WHERE _merge IN (2, 3)")
def merged_one_to_many(t: Tables) -> DataFrame:
    """One to many, keeping matches and rows of the many side."""
    left, right = merge_sides(t)
    out = M.merge_tables(right.withColumn("side", F.lit("right")), left, "k", "1:m", keep=(1, 3))
    # seen from the other side: matched rows keep the right value of a shared column
    return out.select("o_orderkey", "k", F.when(F.col("_merge") == 3, "left").otherwise(F.col("side")).alias("side"), "price",
                      "c_mktsegment", F.when(F.col("_merge") == 1, 2).otherwise(3).cast("int").alias("_merge"))


@query("""
SELECT o_orderkey, c_custkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = CASE WHEN n_regionkey = 2 THEN n_nationkey + 100 ELSE n_nationkey END""")
def inner_and_left(t: Tables) -> DataFrame:
    """A required and an optional lookup."""
    df = M.lookup(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, "c_custkey", ["c_mktsegment", "c_nationkey"])
    other = F.when(F.col("n_regionkey") == 2, F.col("n_nationkey") + 100)  # keys of no customer
    nations = t.nation.withColumn("c_nationkey", other.otherwise(F.col("n_nationkey")))
    df = M.lookup(df, nations, "c_nationkey", ["n_name"], required=False)
    return df.select("o_orderkey", "c_custkey", "c_mktsegment", "n_name")


@query(f"""
WITH a AS (SELECT o_custkey AS k, {sql_quarter('o_orderdate')} AS q, CAST(count(*) AS BIGINT) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
  b AS (SELECT o_custkey AS k, {sql_quarter('o_orderdate')} AS q, CAST(count(*) AS BIGINT) AS n_low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.q, b.q) AS q, n_urgent, n_low FROM a FULL JOIN b ON a.k = b.k AND a.q = b.q""")
def full_outer(t: Tables) -> DataFrame:
    """Two fact tables merged one to one, nothing dropped."""
    o = t.orders.select(F.col("o_custkey").alias("k"), D.quarter_index("o_orderdate").alias("q"), "o_orderpriority")
    a = C.count_by(o.filter("o_orderpriority = '1-URGENT'"), ["k", "q"], "n_urgent")
    b = C.count_by(o.filter("o_orderpriority = '5-LOW'"), ["k", "q"], "n_low")
    return M.merge_tables(a, b, ["k", "q"], "1:1", indicator=None, null_safe=False)


@query(f"""
WITH {MERGE_SIDES}, f AS ({MERGE_FULL})
SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM (
  SELECT CASE _merge WHEN 3 THEN 'matched' WHEN 1 THEN 'left' ELSE 'right' END AS part, k FROM f) GROUP BY 1""")
def split_tables(t: Tables) -> DataFrame:
    """Matched rows and the two differences of two tables."""
    left, right = merge_sides(t)
    parts = dict(zip(("matched", "left", "right"), M.split_match(left, right, "k", "m:1")))
    stacked = M.append(*[p.select(F.lit(n).alias("part"), "k") for n, p in parts.items()])
    return stacked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))


@query("""
SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
WHERE c_custkey IS NOT NULL OR o_orderpriority = '1-URGENT'""")
def matched_or_condition(t: Tables) -> DataFrame:
    """Rows that found a match, or meet a condition without one."""
    people = t.customer.filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    df = M.merge_keep_or(t.orders, people, "o_custkey", F.col("o_orderpriority") == "1-URGENT", using=["c_mktsegment"])
    return df.select("o_orderkey", "o_custkey", "c_mktsegment")


ROSTER_SQL = """
k AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(round(c_acctbal / 500) AS INTEGER) AS band FROM customer),
a0 AS (SELECT c_custkey AS a_key, c_nationkey, c_mktsegment, band + CASE WHEN c_mktsegment = 'FURNITURE' THEN 1000 ELSE 0 END AS band FROM k),
b0 AS (SELECT c_custkey AS b_key, c_nationkey, c_mktsegment, band + CASE WHEN c_mktsegment = 'MACHINERY' THEN 2000 ELSE 0 END AS band FROM k),
c0 AS (SELECT c_custkey AS b_key, c_nationkey, c_mktsegment, band + CASE WHEN c_mktsegment = 'BUILDING' THEN 3000 ELSE 0 END AS band FROM k),
a AS (SELECT * FROM a0 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) = 1),
b AS (SELECT * FROM b0 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) = 1),
c AS (SELECT * FROM c0 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) = 1)"""
LINK = ["c_nationkey", "c_mktsegment", "band"]


def link_sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", (F.round(F.col("c_acctbal") / 500)).cast("int").alias("band"))

    def apart(segment: str, by: int) -> DataFrame:
        """All persons; those of one segment have link keys that no other side has."""
        return k.withColumn("band", F.when(F.col("c_mktsegment") == segment, F.col("band") + by).otherwise(F.col("band")))

    a = apart("FURNITURE", 1000).withColumnRenamed("c_custkey", "a_key")
    b = apart("MACHINERY", 2000).withColumnRenamed("c_custkey", "b_key")
    c = apart("BUILDING", 3000).withColumnRenamed("c_custkey", "b_key")
    return a, b, c


@query(f"WITH {ROSTER_SQL} SELECT a_key, b_key, c_nationkey, c_mktsegment, band FROM a JOIN b USING (c_nationkey, c_mktsegment, band)")
def linked_pairs(t: Tables) -> DataFrame:
    """Exact linkage on a composite key of one type on both sides."""
    a, b, _ = link_sides(t)
    padded = b.withColumn("c_nationkey", X.to_text("c_nationkey", 2))
    return L.link_exact(a, L.normalise_keys(padded, {"c_nationkey": lambda c: X.to_number(c, kind="int")}), LINK)


@query(f"""WITH {ROSTER_SQL}, p1 AS (SELECT a_key, b_key, 1 AS link_pass FROM a JOIN b USING (c_nationkey, c_mktsegment, band)),
  rest AS (SELECT * FROM a ANTI JOIN b USING (c_nationkey, c_mktsegment, band)),
  p2 AS (SELECT a_key, b_key, 2 AS link_pass FROM rest JOIN c USING (c_nationkey, c_mktsegment, band)),
  none AS (SELECT a_key, NULL AS b_key, 0 AS link_pass FROM rest ANTI JOIN c USING (c_nationkey, c_mktsegment, band))
SELECT a_key, b_key, CAST(link_pass AS INTEGER) AS link_pass FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM none)""")
def link_cascade(t: Tables) -> DataFrame:
    """First pool, then what is left against a second pool, and the rest."""
    a, b, c = link_sides(t)
    linked, rest = L.link_cascade(a, [b, c], LINK)
    both = M.append(linked.select("a_key", "b_key", "link_pass"), rest.select("a_key", F.lit(0).alias("link_pass")))
    return both.select("a_key", "b_key", "link_pass")


@query(f"""
WITH {ROSTER_SQL}, d AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d1, CAST(max(o_orderdate) AS DATE) AS d2 FROM orders GROUP BY 1),
  p AS (SELECT a_key, b_key, x.d1 AS a1, x.d2 AS a2, y.d1 AS b1, y.d2 AS b2 FROM a JOIN b USING (c_nationkey, c_mktsegment, band)
        JOIN d x ON x.o_custkey = a_key JOIN d y ON y.o_custkey = b_key)
SELECT a_key, b_key, CAST(date_diff('day', b1, a1) AS INTEGER) AS gap_first, CAST(date_diff('day', b2, a2) AS INTEGER) AS gap_last,
  CAST(greatest(abs(date_diff('day', b1, a1)), abs(date_diff('day', b2, a2))) AS INTEGER) AS widest_gap
FROM p WHERE a_key IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))""")
def reviewed_pairs(t: Tables) -> DataFrame:
    """The review queue with date gaps, and the pairs a reviewer approved."""
    a, b, _ = link_sides(t)
    days = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(
        D.to_day(F.min("o_orderdate")).alias("d1"), D.to_day(F.max("o_orderdate")).alias("d2"))
    pairs = L.link_exact(a, b, LINK)
    for side in "ab":
        pairs = M.lookup(pairs, days.toDF(f"{side}_key", f"{side}1", f"{side}2"), f"{side}_key")
    queue = L.review_candidates(pairs, {"gap_first": ("a1", "b1"), "gap_last": ("a2", "b2")})
    good = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    decisions = C.any_by(t.orders.withColumnRenamed("o_custkey", "a_key"), "a_key", {"keep": good})
    return L.apply_review(queue, decisions, "a_key").select("a_key", "b_key", "gap_first", "gap_last", "widest_gap")


@query("SELECT c_custkey, CAST(q AS INTEGER) AS q FROM customer CROSS JOIN (SELECT unnest(range(140, 167)) AS q)")
def person_periods(t: Tables) -> DataFrame:
    """Every person in every period."""
    return M.cross_panel(t.customer.select("c_custkey"), 140, 166)


@query("""
SELECT c_custkey, n_regionkey AS area_value FROM customer JOIN nation ON c_nationkey = nullif(n_nationkey, 7)""")
def area_lookup(t: Tables) -> DataFrame:
    """Inner lookup of an area value; one area's key is missing."""
    index = t.nation.select(F.nullif("n_nationkey", F.lit(7)).alias("c_nationkey"), F.col("n_regionkey").alias("area_value"))
    return M.lookup(t.customer, index, "c_nationkey").select("c_custkey", "area_value")


@query("""
WITH k AS (SELECT concat(l_suppkey, '-', o_custkey) AS site_key, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey AS person, CAST(count(DISTINCT site_key) AS BIGINT) AS n_sites, round(sum(l_quantity), 2) AS quantity FROM k GROUP BY 1""")
def persons_of_sites(t: Tables) -> DataFrame:
    """Site-level keys mapped to persons; one person has several sites."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.concat_ws("-", "l_suppkey", "o_custkey").alias("site_key"), "l_quantity", "o_custkey")
    patient = rows.select("site_key", F.col("o_custkey").alias("person")).distinct()
    brief = rows.groupBy("site_key").agg(F.sum("l_quantity").alias("quantity"))
    df = M.map_to_person(brief, patient, "site_key", "person", validate=True)
    return df.groupBy("person").agg(F.count(F.lit(1)).alias("n_sites"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("""
WITH u AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, round(CASE WHEN top IS NOT NULL AND c_mktsegment = 'BUILDING' THEN top ELSE c_acctbal END, 2) AS balance,
  CASE WHEN nullif(c_mktsegment, 'MACHINERY') = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS segment
FROM customer LEFT JOIN u ON c_custkey = o_custkey""")
def filled_across(t: Tables) -> DataFrame:
    """Values filled from another source only where it has one, for one group."""
    top = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    df = M.lookup(t.customer, top, "c_custkey", required=False)
    df = M.cross_fill(df, {
        "c_acctbal": (F.col("top"), F.col("top").isNotNull() & (F.col("c_mktsegment") == "BUILDING")),
        "c_mktsegment": (F.lit("B"), F.nullif("c_mktsegment", F.lit("MACHINERY")) == "BUILDING")})
    return df.select("c_custkey", F.round("c_acctbal", 2).alias("balance"), F.col("c_mktsegment").alias("segment"))
