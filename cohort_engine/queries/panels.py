"""Queries for event counts, the panel, outcomes, strata and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..operators import collapse as C, filters as FL, report
from ..plans import events as E, panel as P
from ..session import shared_folder, stable
from ..sources import tables as S
from .base import PART_SETS, PART_SETS_SQL, Tables, query, rounded, sql_month, sql_quarter
from .cohorts import SAMPLE_SQL, study_sample

FIRST_Q, LAST_Q = D.yq(1995, 1), D.yq(2001, 3)
WINDOW = (D.ym(1996, 1), D.ym(2001, 3))

EVENTS_SQL = f"""
ev AS (SELECT o_custkey AS person, l_suppkey AS practice, nullif(l_partkey, 500) AS provider, {sql_month('l_shipdate')} AS m,
  CASE WHEN l_returnflag = 'R' THEN concat(l_partkey, '/', l_suppkey) WHEN l_returnflag = 'N' AND l_quantity > 45 THEN p_brand
       WHEN l_quantity = 1 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
codes AS (SELECT person, practice, provider, m, TRY_CAST(unnest(string_split(code, '/')) AS INTEGER) AS code_num FROM ev
  WHERE m BETWEEN {WINDOW[0]} AND {WINDOW[1]} AND NOT coalesce(regexp_matches(code, '[A-Za-z]'), false) AND code IS DISTINCT FROM '0'),
clean AS (SELECT * FROM codes WHERE code_num BETWEEN 1 AND 1900)"""


def person_events(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines as dated events of a site-level key, and the map of sampled persons."""
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey")))
    site_key = F.concat_ws("-", "l_suppkey", "o_custkey").alias("site_key")
    number = F.col("l_partkey").cast("string")
    code = (F.when(F.col("l_returnflag") == "R", F.concat_ws("/", "l_partkey", "l_suppkey"))
            .when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45), F.col("p_brand"))
            .when(F.col("l_quantity") == 1, F.lit(None)).otherwise(number))
    events = rows.select(site_key, F.col("l_suppkey").alias("practice"), F.nullif("l_partkey", F.lit(500)).alias("provider"),
                         "l_shipdate", code.alias("code"), F.col("p_type").alias("kind"))
    patient = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
               .select(site_key, F.col("o_custkey").alias("person")).distinct())
    sample = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("person"))
    return events, E.sample_map(patient, sample, "site_key", "person")


def clean_part_events(t: Tables) -> DataFrame:
    events, people = person_events(t)
    return E.clean_events(events, people, "site_key", "person", "code", "l_shipdate", WINDOW, (1, 1900))


@query(f"WITH {EVENTS_SQL} SELECT person, practice, provider, m, code_num, CAST(count(*) AS BIGINT) AS n FROM clean GROUP BY ALL")
def cleaned_events(t: Tables) -> DataFrame:
    """Windowed events of sampled persons, one row per valid code."""
    events = clean_part_events(t).withColumnRenamed("month", "m")
    return C.count_by(events, ["person", "practice", "provider", "m", "code_num"])


@query(f"""WITH {EVENTS_SQL} SELECT person, CAST(m // 3 AS INTEGER) AS q, """ + ", ".join(
    f"CAST(sum(CASE WHEN {c.format(c='code_num')} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in PART_SETS_SQL.items()) + """,
  CAST(count(DISTINCT practice) AS BIGINT) AS prac_num,
  CAST(count(DISTINCT provider) + max(CASE WHEN provider IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS prov_num FROM clean GROUP BY ALL""")
def service_counts(t: Tables) -> DataFrame:
    """Counts by code set and distinct practices and providers per person-quarter (C11)."""
    events = clean_part_events(t).withColumn("q", D.quarter_of_month("month"))
    return E.event_counts(events, ["person", "q"], "code_num", PART_SETS, {"prac_num": "practice", "prov_num": "provider"})


MONTHLY_PARTS_SQL = f"""
ev AS (SELECT c_nationkey, nullif(l_partkey, 500) AS part, {sql_month('l_shipdate')} AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _distinct_sql(unit: str, months: int) -> str:
    return (f"SELECT c_nationkey, '{unit}' AS unit, CAST(m // {months} AS INTEGER) AS period, "
            "CAST(count(DISTINCT part) + max(CASE WHEN part IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ev GROUP BY ALL")


@query(f"WITH {MONTHLY_PARTS_SQL} " + " UNION ALL ".join(_distinct_sql(*x) for x in (("month", 1), ("quarter", 3), ("year", 12))))
def distinct_by_period(t: Tables) -> DataFrame:
    """Different providers per area by month, quarter and year from one pass (A2, A3)."""
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select("c_nationkey", F.nullif("l_partkey", F.lit(500)).alias("part"), D.month_index("l_shipdate").alias("m")))
    return C.distinct_by_period(rows, "c_nationkey", "m", "part")


@query(f"""
SELECT l_suppkey, {sql_month('l_shipdate')} AS m, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_returned
FROM lineitem GROUP BY ALL""")
def counts_after_later_extract(t: Tables) -> DataFrame:
    """Monthly counts of an older extract, brought up to date by a later one that shares a month with it."""
    cut, folder = D.ym(1999, 6), f"{shared_folder(t.spark)}/extracts-{uuid.uuid4().hex}"
    rows = t.lineitem.select("l_suppkey", "l_returnflag", "l_linenumber", D.month_index("l_shipdate").alias("m"))
    older = (F.col("m") < cut) | ((F.col("m") == cut) & (F.col("l_linenumber") % 2 == 0))

    def count(events: DataFrame) -> DataFrame:
        return events.groupBy("l_suppkey", "m").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))

    for name, extract in (("older", rows.filter(older)), ("later", rows.filter(~older))):
        S.add_extract(t.spark, extract, name, f"{folder}/events", f"{folder}/counts", "m", count)
    return S.read_table(t.spark, f"{folder}/counts").select("l_suppkey", "m", "n", "n_returned")


@query(f"""
SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS price
FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL""")
def bucketed_events(t: Tables) -> DataFrame:
    """Events laid out by period and person, joined to persons laid out alike without an exchange of either."""
    tag = uuid.uuid4().hex
    folder = f"{shared_folder(t.spark)}/bucketed-{tag}"
    events = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", F.year("o_orderdate").alias("year"))
    S.write_bucketed(events, f"events_{tag}", f"{folder}/events", "c_custkey", 8, "year")
    S.write_bucketed(t.customer.select("c_custkey", "c_mktsegment"), f"persons_{tag}", f"{folder}/persons", "c_custkey", 8)
    joined = t.spark.table(f"events_{tag}").filter("year BETWEEN 1996 AND 1998").join(t.spark.table(f"persons_{tag}"), "c_custkey")
    out = joined.groupBy("c_mktsegment", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return out.select("c_mktsegment", "year", "n", "price")


REFERRALS = {"n_all": None, "n_urgent": ["1-URGENT"], "n_soon": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "n_low": ["5-LOW"]}


@query(f"""
SELECT o_custkey AS person, {sql_quarter('o_orderdate')} AS q, """ + ", ".join(
    "CAST(count(*) AS BIGINT) AS n_all" if v is None else
    f"CAST(count(*) FILTER (o_orderpriority IN ({', '.join(repr(x) for x in v)})) AS BIGINT) AS {n}" for n, v in REFERRALS.items())
    + f" FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD' AND {sql_month('o_orderdate')} BETWEEN {WINDOW[0]} AND {WINDOW[1]} GROUP BY ALL")
def referral_counts(t: Tables) -> DataFrame:
    """Counts by category, month then quarter."""
    key = F.concat_ws("-", "o_orderstatus", "o_custkey").alias("site_key")
    events = t.orders.select(key, "o_orderpriority", "o_orderdate")
    patient = t.orders.select(key, F.col("o_custkey").alias("person")).distinct()
    people = E.sample_map(patient, t.customer.filter("c_mktsegment <> 'HOUSEHOLD'").withColumnRenamed("c_custkey", "person"), "site_key", "person")
    tests = {n: F.lit(True) if v is None else F.col("o_orderpriority").isin(*v) for n, v in REFERRALS.items()}
    return E.category_counts(events, people, "site_key", "person", "o_orderdate", tests, WINDOW)


LETTERS = ["E", "L", "M", "P", "S"]
SCRIPTS_SQL = f"""
sc AS (SELECT o_custkey AS person, {sql_quarter('l_shipdate')} AS q, substring(p_type, 1, 1) AS letter
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND {sql_month('l_shipdate')} BETWEEN {WINDOW[0]} AND {WINDOW[1]})"""


@query(f"WITH {SCRIPTS_SQL} SELECT person, q, " + ", ".join(
    f"CAST(count(*) FILTER (letter = '{x}') AS BIGINT) AS class_{x}" for x in LETTERS) + " FROM sc GROUP BY ALL")
def class_counts(t: Tables) -> DataFrame:
    """Counts by first letter of the class, month then quarter."""
    events, people = person_events(t)
    letter = F.substring("kind", 1, 1)
    return E.category_counts(events, people, "site_key", "person", "l_shipdate", {f"class_{x}": letter == x for x in LETTERS}, WINDOW)


@query(f"WITH {SCRIPTS_SQL} SELECT person, q, CAST(count(*) FILTER (letter <> 'S') AS BIGINT) AS any_class FROM sc GROUP BY ALL")
def any_class_counts(t: Tables) -> DataFrame:
    """Quarterly total of the listed classes, one letter left out (C14)."""
    events, people = person_events(t)
    return E.any_class_count(events, people, "site_key", "person", "l_shipdate", F.substring("kind", 1, 1), LETTERS[:-1], "any_class", WINDOW)


def order_facts(t: Tables) -> list[tuple[DataFrame, list[str]]]:
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), D.quarter_index("o_orderdate").alias("q"), "o_orderkey", "o_orderpriority")
    counts = o.groupBy("c_custkey", "q").agg(F.count(F.lit(1)).alias("n_orders"),
                                             F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n_urgent"))
    # lines are summed per order first, so that the join moves one row per order
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    sums = per_order.join(o.select("o_orderkey", "c_custkey", "q"), "o_orderkey").groupBy("c_custkey", "q").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("quantity").alias("quantity"))
    return [(counts, ["n_orders", "n_urgent"]), (sums, ["n_lines", "quantity"])]


PANEL_SQL = f"""
per AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, CAST(unnest(range({FIRST_Q}, {LAST_Q} + 1)) AS INTEGER) AS q FROM customer),
f1 AS (SELECT o_custkey AS c_custkey, {sql_quarter('o_orderdate')} AS q, count(*) AS n_orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY ALL),
f2 AS (SELECT o_custkey AS c_custkey, {sql_quarter('o_orderdate')} AS q, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
panel AS (SELECT per.*, CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders, CAST(coalesce(n_urgent, 0) AS BIGINT) AS n_urgent,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(quantity, 0) AS DOUBLE) AS quantity
  FROM per LEFT JOIN f1 USING (c_custkey, q) LEFT JOIN f2 USING (c_custkey, q))"""


def order_panel(t: Tables) -> DataFrame:
    return P.build_panel(t.customer.drop("c_name"), FIRST_Q, LAST_Q, order_facts(t), "c_custkey")


@query(f"WITH {PANEL_SQL} SELECT c_custkey, q, n_orders, n_urgent, n_lines, round(quantity, 2) AS quantity FROM panel")
def balanced_panel(t: Tables) -> DataFrame:
    """Every person in every quarter with counts, 0 where there are none."""
    return order_panel(t).select("c_custkey", "q", "n_orders", "n_urgent", "n_lines", F.round("quantity", 2).alias("quantity"))


ENDS_SQL = f"""
ends AS (SELECT o_custkey AS c_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS died,
  max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'P' AND o_totalprice > 450000) AS left_on,
  {sql_quarter("max(o_orderdate) FILTER (o_totalprice > 480000)")} AS registry FROM orders GROUP BY 1),
followed AS (SELECT panel.*, CASE WHEN c_mktsegment <> 'BUILDING' AND registry IS NOT NULL THEN registry ELSE {sql_quarter('coalesce(died, left_on)')} END AS q_dead
  FROM panel LEFT JOIN ends USING (c_custkey)),
kept AS (SELECT * FROM followed WHERE (q_dead IS NULL OR q < q_dead) AND (q_dead IS NULL OR q_dead >= 150))"""


def followed_panel(t: Tables, panel: DataFrame | None = None) -> DataFrame:
    """The panel, built here or before, censored at the end of each person's follow-up."""
    day = F.date_format("o_orderdate", "d/M/yyyy")
    low, dear = F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")
    ends = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when((F.col("o_orderstatus") == "F") & low, D.to_day("o_orderdate"))).alias("withdrawn"),
        F.max_by(day, F.when((F.col("o_orderstatus") == "P") & (dear > 450000), F.col("o_orderdate"))).alias("left_text"),
        D.quarter_index(F.max(F.when(dear > 480000, F.col("o_orderdate")))).alias("registry"))
    merged = (order_panel(t) if panel is None else panel).join(ends.withColumn("reason", F.lit("Died")), "c_custkey", "left")
    out = P.end_of_followup(merged, P.died_on("reason", "withdrawn"), P.text_end("left_text"), F.col("registry"),
                            F.col("c_mktsegment") != "BUILDING")
    return FL.censor_after(out, "q", "q_dead", 150)


@query(f"WITH {PANEL_SQL}, {ENDS_SQL} SELECT c_custkey, q, q_dead, n_orders FROM kept")
def censored_panel(t: Tables) -> DataFrame:
    """Follow-up ends by withdrawal, text date or registry, then censoring."""
    return followed_panel(t).select("c_custkey", "q", "q_dead", "n_orders")


@query(f"""WITH {PANEL_SQL} SELECT c_custkey, q, n_orders + n_lines AS contacts, n_orders + n_urgent + n_lines AS all_contacts,
  round(ln(n_orders + n_lines + 0.1), 6) AS contacts_LN, round(ln(quantity + 0.1), 6) AS quantity_LN FROM panel""")
def outcomes(t: Tables) -> DataFrame:
    """Composite outcomes and their logs (C17)."""
    out = P.derive_outcomes(order_panel(t), {"contacts": ["n_orders", "n_lines"], "all_contacts": ["n_orders", "n_urgent", "n_lines"]},
                            ["contacts", "quantity"])
    return out.select("c_custkey", "q", "contacts", "all_contacts", rounded("contacts_LN").alias("contacts_LN"),
                      rounded("quantity_LN").alias("quantity_LN"))


SPELLS_SQL = """
sp AS (SELECT o_custkey AS c_custkey, min(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT') AS sa, min(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '2-HIGH') AS sb,
  max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS ea,
  max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F') AS eb FROM orders GROUP BY 1),
days AS (SELECT c_custkey, CAST(CASE WHEN sa IS NOT NULL AND ea IS NULL THEN date_diff('day', sa, DATE '2001-10-01')
    WHEN sb IS NOT NULL AND eb IS NULL THEN date_diff('day', sb, DATE '2001-10-01')
    ELSE coalesce(date_diff('day', sa, ea), date_diff('day', sb, eb)) END AS INTEGER) AS days FROM sp)"""


def spells(t: Tables) -> DataFrame:
    day, urgent, high = D.to_day("o_orderdate"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.when(urgent, day)).alias("sa"), F.min(F.when(high, day)).alias("sb"),
        F.max(F.when(urgent & done, day)).alias("ea"), F.max(F.when(high & done, day)).alias("eb"))


def spell_length() -> F.Column:
    return P.spell_days(["ea", "eb"], ["sa", "sb"], F.lit("2001-10-01").cast("date"))


@query(f"""
WITH {PANEL_SQL}, {ENDS_SQL}, {SPELLS_SQL},
r AS (SELECT kept.*, days, n_regionkey AS area FROM kept LEFT JOIN days USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT *, CAST(1 + (area > (SELECT quantile_cont(area, 0.5) FROM r))::INTEGER AS INTEGER) AS index_half FROM r),
x AS (SELECT * FROM h WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')),
z AS (SELECT *, (SELECT quantile_cont(days, 0.5) FROM x) AS cut FROM x)
SELECT c_custkey, q, index_half, CAST(c_acctbal >= 5000 AS INTEGER) AS age_high, days AS duration_days,
  CAST(CASE WHEN days IS NULL THEN 3 WHEN days > cut THEN 2 ELSE 1 END AS INTEGER) AS duration_half FROM z""")
def strata(t: Tables) -> DataFrame:
    """Area halves, age class and programme-duration halves over panel rows."""
    areas = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("area"))
    panel = followed_panel(t).join(spells(t), "c_custkey", "left").join(areas, "c_nationkey")
    out = P.derive_strata(panel, "area", "c_acctbal", spell_length(), 5000, "c_mktsegment", ("BUILDING", "MACHINERY", "FURNITURE"))
    return out.select("c_custkey", "q", "index_half", "age_high", "duration_days", "duration_half")


FIRST_SQL = f"""
tq AS (SELECT o_custkey AS c_custkey, {sql_quarter('min(o_orderdate)')} AS first_q FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1998-01-01' GROUP BY 1)"""


def first_treatment(t: Tables) -> DataFrame:
    """Quarter of the first urgent order from 1998 on, for one segment."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1998-01-01'")
    people = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return urgent.join(people, "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        D.quarter_index(F.min("o_orderdate")).alias("first_q"))


@query(f"""
WITH {PANEL_SQL}, {ENDS_SQL}, {FIRST_SQL}
SELECT c_custkey, q, CAST(dense_rank() OVER (ORDER BY c_custkey) AS BIGINT) AS unit, CAST(dense_rank() OVER (ORDER BY q) AS BIGINT) AS tvar,
  CAST(q - first_q AS INTEGER) AS trel, CAST(coalesce(q - first_q >= -4, false) AS INTEGER) AS treat
FROM kept LEFT JOIN tq USING (c_custkey)""")
def event_study_columns(t: Tables) -> DataFrame:
    """Unit and period numbers, event time and lagged treatment."""
    panel = followed_panel(t).join(first_treatment(t), "c_custkey", "left").select("c_custkey", "q", "first_q")
    return P.event_study_columns(stable(panel), "c_custkey", "q", "first_q").select("c_custkey", "q", "unit", "tvar", "trel", "treat")


def _percentile_sql(p: int) -> str:
    return (f"avg(v) FILTER (rn IN (CASE WHEN (n * {p}) % 100 = 0 THEN (n * {p}) // 100 ELSE (n * {p}) // 100 + 1 END, (n * {p}) // 100 + 1))")


_DURATION_GROUPS = {"all": "true", "urgent_only": "sa IS NOT NULL AND sb IS NULL", "other": "sb IS NOT NULL"}


@query(f"""WITH {SPELLS_SQL}, g AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS grp, days AS v FROM days JOIN sp USING (c_custkey) WHERE {c}" for n, c in _DURATION_GROUPS.items()) + """),
r AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM g WHERE v IS NOT NULL),
m AS (SELECT grp, avg(v) AS mean, stddev_samp(v) AS sd FROM r GROUP BY 1)
""" + " UNION ALL ".join(
    [f"SELECT grp AS \"group\", 'p{p}' AS stat, round({_percentile_sql(p)}, 4) AS value FROM r GROUP BY grp" for p in C.DETAIL_PERCENTS]
    + ["SELECT grp, 'n', round(CAST(max(n) AS DOUBLE), 4) FROM r GROUP BY grp", "SELECT grp, 'mean', round(mean, 4) FROM m", "SELECT grp, 'sd', round(sd, 4) FROM m",
       "SELECT grp, concat('smallest_', rn), round(CAST(v AS DOUBLE), 4) FROM r WHERE rn <= 4",
       "SELECT grp, concat('largest_', n - rn + 1), round(CAST(v AS DOUBLE), 4) FROM r WHERE rn > n - 4"]))
def duration_summaries(t: Tables) -> DataFrame:
    """Person-level summary of programme duration by group."""
    people = spells(t).withColumn("days", spell_length())
    out = report.duration_summary(people, "c_custkey", "days", {
        "all": F.lit(True), "urgent_only": F.col("sa").isNotNull() & F.col("sb").isNull(), "other": F.col("sb").isNotNull()})
    out = out.filter(~F.col("stat").isin("sum", "variance", "skewness", "kurtosis"))
    return out.select("group", "stat", F.round("value", 4).alias("value"))


@query(f"""
WITH {PANEL_SQL}, {ENDS_SQL}, {SAMPLE_SQL}
SELECT CAST(step AS INTEGER) AS step, name, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_persons AS BIGINT) AS n_persons FROM (
  SELECT 1 AS step, 'panel' AS name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_persons FROM panel
  UNION ALL SELECT 2, 'followed', count(*), count(DISTINCT c_custkey) FROM kept
  UNION ALL SELECT 3, 'sample', count(*), count(DISTINCT person) FROM u, bound WHERE age >= lo)""")
def attrition(t: Tables) -> DataFrame:
    """Rows and persons after each step, counted by the jobs that store panel and sample."""
    steps, first = report.Attrition("c_custkey"), F.col("q") == FIRST_Q  # follow-up ends later, so every person keeps that quarter
    panel = steps.passed("panel", order_panel(t).select("c_custkey", "q", "c_mktsegment"), first)
    stable(steps.passed("followed", followed_panel(t, panel), first))
    stable(steps.passed("sample", study_sample(t)))
    return steps.table(t.spark)
