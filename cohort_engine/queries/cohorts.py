"""Queries for rosters, condition profiles, timelines, linkage and the study sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, text as X
from ..operators import collapse as C
from ..plans import linking, rosters, sample as SP, timelines
from ..operators.report import Attrition
from ..plans.conditions import condition_profile as build_profile
from ..session import stable
from .base import Tables, query, sql_month, sql_quarter, text
from .joins import LINK, ROSTER_SQL, link_sides

PEOPLE_SQL = """
people AS (SELECT c_custkey, c_nationkey, c_mktsegment AS sex, CAST(round(c_acctbal / 1000) AS INTEGER) AS post_code,
  DATE '1930-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS birth_date FROM customer),
found AS (SELECT o_custkey, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def people(t: Tables) -> DataFrame:
    born = F.date_add(F.lit("1930-01-01").cast("date"), ((F.col("c_custkey") * 37) % 20000).cast("int"))
    return t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("sex"),
                             F.round(F.col("c_acctbal") / 1000).cast("int").alias("post_code"), born.alias("birth_date"))


def found(t: Tables) -> DataFrame:
    """Conditions of persons: types of the lines of their orders."""
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select("o_custkey", "p_type", "l_suppkey", "l_shipdate"))


SETS = {"cardio": ["ECONOMY"], "resp": ["SMALL", "MEDIUM"], "frailty": ["PROMO"]}
SETS_SQL = """CAST(max(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS INTEGER) AS cardio,
  CAST(max(CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 1 ELSE 0 END) AS INTEGER) AS resp,
  CAST(max(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) AS INTEGER) AS frailty"""


def _series_sql(prefix: str, column: str, n: int) -> tuple[str, str]:
    ranked = f"row_number() OVER (PARTITION BY key ORDER BY {column} NULLS LAST) AS {prefix}_seq"
    picks = ", ".join(f"strftime(min({column}) FILTER ({prefix}_seq = {i}), '%Y-%m-%d') AS {prefix}_{i}_a" for i in range(1, n + 1))
    return ranked, picks


_SERIES = [_series_sql(p, p, 3) for p in ("enrolled", "graduated", "withdrawn")]


@query(f"""
WITH {PEOPLE_SQL},
raw AS (SELECT o_custkey AS key, CASE WHEN c_nationkey = 24 THEN '23' ELSE CAST(c_nationkey AS VARCHAR) END AS practice_id, sex, post_code, birth_date,
  CAST(o_orderdate AS DATE) AS enrolled, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS graduated,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) + 30 END AS withdrawn,
  CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN 'Died' ELSE 'Moved' END END AS withdrawal_reason
  FROM orders JOIN people ON o_custkey = c_custkey WHERE sex <> 'FURNITURE'),
roster AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY key, enrolled ORDER BY graduated NULLS LAST, withdrawal_reason NULLS LAST, withdrawn NULLS LAST) = 1),
seqs AS (SELECT *, {', '.join(r for r, _ in _SERIES)} FROM roster),
dates AS (SELECT key, {', '.join(p for _, p in _SERIES)} FROM seqs GROUP BY 1),
firsts AS (SELECT * FROM roster QUALIFY row_number() OVER (PARTITION BY key ORDER BY withdrawn NULLS LAST, enrolled, graduated NULLS LAST, withdrawal_reason NULLS LAST) = 1),
cond AS (SELECT o_custkey AS key, {SETS_SQL} FROM found GROUP BY 1),
merged AS (SELECT post_code, CAST(year(birth_date) AS INTEGER) AS yob, CAST(month(birth_date) AS INTEGER) AS mob, sex, practice_id,
  dates.* EXCLUDE (key), coalesce(cardio, 0) AS cardio_a, coalesce(resp, 0) AS resp_a, coalesce(frailty, 0) AS frailty_a,
  CAST(cond.key IS NULL AS INTEGER) AS diag_miss_a, withdrawal_reason
  FROM firsts JOIN dates USING (key) FULL JOIN cond ON firsts.key = cond.key)
SELECT * FROM merged QUALIFY count(*) OVER (PARTITION BY post_code, yob, mob, sex, practice_id) = 1""")
def roster_with_dates(t: Tables) -> DataFrame:
    """A roster of spells to one row per person: site aliases, n-th dates of three series,
    condition flags, unambiguous link key (C1)."""
    day, late = D.to_day("o_orderdate"), F.col("o_orderpriority") == "5-LOW"
    raw = t.orders.join(people(t), F.col("o_custkey") == F.col("c_custkey")).filter("sex <> 'FURNITURE'").select(
        F.col("o_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("practice_id"), "sex", "post_code", "birth_date",
        day.alias("enrolled"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("graduated"),
        F.when(late, F.date_add(day, 30)).alias("withdrawn"),
        F.when(late, F.when(F.col("o_orderstatus") == "P", "Died").otherwise("Moved")).alias("withdrawal_reason"))
    spec = rosters.RosterSpec(
        key="key", link_keys=["post_code", "yob", "mob", "sex", "practice_id"], birth_date="birth_date",
        site_aliases={"24": "23"}, series={s: (s, 3) for s in ("enrolled", "graduated", "withdrawn")},
        repeat_keys=("key", "enrolled"), first_by=("withdrawn",), condition_key="o_custkey", condition="p_type",
        condition_sets=SETS, suffix="_a", keep=("withdrawal_reason",))
    out = rosters.roster_profile(raw, found(t).select("o_custkey", "p_type"), spec)
    dates = [c for c, kind in out.dtypes if kind == "date"]
    return out.withColumns({c: text(c) for c in dates})


@query(f"""
WITH {PEOPLE_SQL},
raw AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS practice_id, sex, post_code, birth_date, CAST(ts AS DATE) AS enrolled, event_type AS reason
  FROM events JOIN people ON user_id = c_custkey WHERE sex <> 'MACHINERY'),
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY enrolled, reason) = 1),
cond AS (SELECT o_custkey AS id, {SETS_SQL} FROM found GROUP BY 1),
merged AS (SELECT post_code, CAST(year(birth_date) AS INTEGER) AS yob, CAST(month(birth_date) AS INTEGER) AS mob, sex, practice_id,
  strftime(enrolled, '%Y-%m-%d') AS enrolled_1_b, coalesce(cardio, 0) AS cardio_b, coalesce(resp, 0) AS resp_b, coalesce(frailty, 0) AS frailty_b,
  CAST(cond.id IS NULL AS INTEGER) AS diag_miss_b, reason FROM firsts LEFT JOIN cond ON firsts.id = cond.id)
SELECT * FROM merged QUALIFY count(*) OVER (PARTITION BY post_code, yob, mob, sex, practice_id) = 1""")
def roster_first_enrolment(t: Tables) -> DataFrame:
    """A roster with the site inside its key and one enrolment per person."""
    raw = t.events.join(people(t), F.col("user_id") == F.col("c_custkey")).filter("sex <> 'MACHINERY'").select(
        F.col("c_custkey").alias("id"), F.concat_ws("-", "c_nationkey", "c_custkey").alias("site_key"), "sex", "post_code", "birth_date",
        D.to_day("ts").alias("enrolled"), F.col("event_type").alias("reason"))
    spec = rosters.RosterSpec(
        key="id", link_keys=["post_code", "yob", "mob", "sex", "practice_id"], birth_date="birth_date", site_key="site_key",
        series={"enrolled": ("enrolled", 1)}, first_by=("enrolled", "reason"), condition_key="o_custkey", condition="p_type",
        condition_sets=SETS, suffix="_b", keep_unknown=False, keep=("reason",))
    out = rosters.roster_profile(raw, found(t).select("o_custkey", "p_type"), spec)
    return out.withColumn("enrolled_1_b", text("enrolled_1_b"))


@query(f"""
WITH d AS (SELECT o_custkey, p_type, {sql_month('l_shipdate')} AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey),
  w AS (SELECT * FROM d WHERE m BETWEEN 432 AND 479),
  p AS (SELECT o_custkey AS person, {', '.join(f"CAST(max(CASE WHEN p_type IN ({v}) THEN 1 ELSE 0 END) AS INTEGER) AS has_{n}, min(m) FILTER (p_type IN ({v})) AS first_{n}"
    for n, v in {"cardio": "'PROMO'", "resp": "'SMALL'", "other": "'LARGE', 'MEDIUM'", "lowest": "'ECONOMY'"}.items())} FROM w GROUP BY 1)
SELECT * FROM p WHERE has_cardio + has_resp > 0""")
def condition_profile(t: Tables) -> DataFrame:
    """Flags and first months of conditions per person, eligible persons only."""
    rows = found(t).select(F.concat_ws("-", "l_suppkey", "o_custkey").alias("site_key"), "o_custkey", "p_type", "l_shipdate")
    patient = rows.select("site_key", F.col("o_custkey").alias("person")).distinct()
    return build_profile(rows.drop("o_custkey"), patient, "site_key", "person", "p_type", "l_shipdate",
                         {"cardio": ["PROMO"], "resp": ["SMALL"], "other": ["LARGE", "MEDIUM"]}, ["cardio", "resp"],
                         (D.ym(1996, 1), D.ym(1999, 12)), "lowest")


FLAGS_SQL = """
f AS (SELECT concat(c_nationkey, '-', c_custkey) AS key, c_nationkey, c_custkey, CAST(ts AS DATE) AS d,
  CASE WHEN value > 60 THEN 'enrolled' WHEN value > 20 THEN 'graduated' WHEN value > 5 THEN 'withdrawn' ELSE 'referred' END AS status
  FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))"""


def status_flags(t: Tables) -> DataFrame:
    v = F.col("value")
    status = (F.when(v > 60, "Program Enrolled").when(v > 20, "Program Graduated").when(v > 5, "Program Withdrawn")
              .when(F.col("event_type") == "view", "Program  Referred").otherwise("Program Referred"))
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(
        F.concat_ws("-", "c_nationkey", "c_custkey").alias("key"), D.to_day("ts").alias("day"), status.alias("status"))


def flag_patients(t: Tables) -> DataFrame:
    return t.customer.select(F.concat_ws("-", "c_nationkey", "c_custkey").alias("key"), F.col("c_custkey").alias("person_id"),
                             (F.lit(1930) + F.col("c_nationkey") * 4).cast("string").alias("yob"), F.col("c_mktsegment").alias("sex"))


def excluded_sites(t: Tables) -> DataFrame:
    return t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("site"))


def _timeline_sql(wanted: dict[str, tuple[str, int]]) -> str:
    return ", ".join(f"strftime(min(d) FILTER (status = '{v}' AND seq = {n}), '%Y-%m-%d') AS {o}" for o, (v, n) in wanted.items())


FIRST_POOL = {**{f"enrolled_{i}": ("enrolled", i) for i in range(1, 5)}, "graduated_1": ("graduated", 1), "graduated_2": ("graduated", 2),
              "withdrawn_1": ("withdrawn", 1), "withdrawn_2": ("withdrawn", 2)}
SECOND_POOL = {k: v for k, v in FIRST_POOL.items() if not k.startswith("enrolled")} | {"referred_1": ("referred", 1)}


@query(f"""
WITH {FLAGS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY d) AS seq FROM f WHERE status <> 'referred'),
  w AS (SELECT key, {_timeline_sql(FIRST_POOL)}, max(status = 'enrolled') AS ever FROM s GROUP BY 1)
SELECT w.* EXCLUDE (ever), c_custkey AS person_id, c_mktsegment AS sex FROM w JOIN customer ON key = concat(c_nationkey, '-', c_custkey)
WHERE ever AND c_mktsegment <> 'BUILDING'""")
def enrolled_timeline(t: Tables) -> DataFrame:
    """Ever-enrolled persons with up to four enrolments, two ends of each kind (C4)."""
    out = timelines.status_timeline(
        status_flags(t), flag_patients(t), "key", "status", "day", ["Program Enrolled", "Program Graduated", "Program Withdrawn"],
        FIRST_POOL, ["person_id", "sex"], ever="enrolled", excluded_sites=excluded_sites(t), drop_when=F.col("sex") == "BUILDING")
    return out.withColumns({c: text(c) for c in FIRST_POOL})


@query(f"""
WITH {FLAGS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY d) AS seq FROM f WHERE status <> 'enrolled'),
  w AS (SELECT key, {_timeline_sql(SECOND_POOL)} FROM s GROUP BY 1)
SELECT w.*, c_custkey AS person_id, CAST(1930 + c_nationkey * 4 AS INTEGER) AS yob FROM w JOIN customer ON key = concat(c_nationkey, '-', c_custkey)
WHERE 2025 - (1930 + c_nationkey * 4) >= 18""")
def second_pool_timeline(t: Tables) -> DataFrame:
    """Adults who graduated, withdrew or were referred, whatever else they hold."""
    out = timelines.status_timeline(
        status_flags(t), flag_patients(t), "key", "status", "day",
        ["Program Graduated", "Program Withdrawn", "Program  Referred", "Program Referred"], SECOND_POOL, ["person_id", "yob"],
        excluded_sites=excluded_sites(t), adult_in=2025)
    return out.withColumns({c: text(c) for c in SECOND_POOL})


@query(f"""
WITH {ROSTER_SQL}, u AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) = 1),
c1 AS (SELECT * FROM c0 QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) = 1),
r AS (SELECT 'a' AS roster, a_key AS r_key, c_nationkey, c_mktsegment, band FROM a UNION ALL SELECT 'b', b_key, c_nationkey, c_mktsegment, band FROM c1),
p1 AS (SELECT roster, r_key, b_key AS person_id, 1 AS link_pass FROM r JOIN b USING (c_nationkey, c_mktsegment, band)),
rest AS (SELECT * FROM r ANTI JOIN b USING (c_nationkey, c_mktsegment, band)),
p2 AS (SELECT roster, r_key, c_custkey AS person_id, 2 AS link_pass FROM rest JOIN u USING (c_nationkey, c_mktsegment, band)
  WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')))
SELECT roster, r_key, person_id, CAST(link_pass AS INTEGER) AS link_pass FROM (FROM p1 UNION ALL FROM p2)""")
def linked_rosters(t: Tables) -> DataFrame:
    """Two rosters linked to two pools in a cascade with review decisions."""
    a, b, c = link_sides(t)
    everyone = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 500).cast("int").alias("band"))
    good = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    decisions = C.any_by(t.orders.withColumnRenamed("o_custkey", "person_id"), "person_id", {"keep": good})
    linked, _ = linking.link_rosters(
        {"a": a.withColumnRenamed("a_key", "r_key"), "b": c.withColumnRenamed("b_key", "r_key")},
        [b.withColumnRenamed("b_key", "person_id"), everyone.withColumnRenamed("c_custkey", "person_id")], LINK,
        {"c_nationkey": lambda x: X.to_number(x, kind="int")}, decisions)
    return linked.select("roster", "r_key", "person_id", "link_pass")


CONDITIONS_SQL = """
prof AS (SELECT CASE WHEN o_orderstatus = 'P' OR o_custkey % 5 = 2 THEN o_custkey + 100000000 ELSE o_custkey END AS person,
  CAST(max(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS INTEGER) AS has_cardio, CAST(max(o_totalprice > 480000) AS INTEGER) AS has_resp FROM orders GROUP BY 1)"""


def order_profile(t: Tables) -> DataFrame:
    """Two conditions per person. Pending orders, and all of a fifth of the customers, are of persons whom no other table has."""
    other = F.when((F.col("o_orderstatus") == "P") | (F.col("o_custkey") % 5 == 2), F.col("o_custkey") + 100_000_000)
    return C.any_by(t.orders.withColumn("person", other.otherwise(F.col("o_custkey"))), "person", {
        "has_cardio": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"),
        "has_resp": F.col("o_totalprice") > 480000})


@query(f"""
WITH {CONDITIONS_SQL}, l AS (SELECT c_custkey AS person, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN CAST(c_acctbal > 5000 AS INTEGER) END AS cardio_a,
    CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN CAST(c_acctbal < 2000 AS INTEGER) END AS cardio_b,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(c_acctbal > 8000 AS INTEGER) END AS resp_a FROM customer),
  j AS (SELECT l.*, has_cardio, has_resp FROM l LEFT JOIN prof USING (person)),
  o AS (SELECT person, CAST(coalesce(cardio_a = 1, false) OR coalesce(cardio_b = 1, false) OR (coalesce(has_cardio = 1, false) AND (cardio_a IS NOT NULL OR cardio_b IS NOT NULL)) AS INTEGER) AS cardio,
    CAST(coalesce(resp_a = 1, false) OR (coalesce(has_resp = 1, false) AND resp_a IS NOT NULL) AS INTEGER) AS resp FROM j)
SELECT *, CAST(cardio = 0 AND resp = 0 AS INTEGER) AS no_cond FROM o""")
def reconciled_conditions(t: Tables) -> DataFrame:
    """Conditions of linked persons from roster and extract."""
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    linked = t.customer.select(
        F.col("c_custkey").alias("person"), F.when(seg.isin("BUILDING", "FURNITURE"), (bal > 5000).cast("int")).alias("cardio_a"),
        F.when(seg.isin("MACHINERY", "FURNITURE"), (bal < 2000).cast("int")).alias("cardio_b"),
        F.when(seg != "HOUSEHOLD", (bal > 8000).cast("int")).alias("resp_a"))
    return SP.reconcile_conditions(linked, order_profile(t), "person", {
        "cardio": ("has_cardio", ["cardio_a", "cardio_b"]), "resp": ("has_resp", ["resp_a"])})


SAMPLE_SQL = f"""
{CONDITIONS_SQL},
keys AS (SELECT concat(l_suppkey, '-', o_custkey) AS key, l_suppkey AS site, o_custkey AS person, max(l_returnflag = 'R' AND l_quantity > 48) AS eligible
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
dead AS (SELECT o_custkey AS person, {sql_quarter("min(o_orderdate) FILTER (o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice > 300000)")} AS date_death FROM orders GROUP BY 1),
urgent AS (SELECT o_custkey AS person, min(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT') AS ea,
    min(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '2-HIGH') AS eb,
    min(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS wa FROM orders GROUP BY 1),
linked AS (SELECT person, ea, eb, CASE WHEN wa > ea OR month(wa) < 4 THEN wa + 2 END AS wa, CAST(c_acctbal > 5000 AS INTEGER) AS cardio, CAST(c_acctbal < 1000 AS INTEGER) AS resp
  FROM urgent JOIN customer ON person = c_custkey WHERE c_mktsegment = 'BUILDING'),
j AS (SELECT k.key, k.person, 1925 + c_nationkey * 3 AS yob, c_nationkey AS post_code, c_mktsegment AS sex, ea, eb, wa, l.cardio, l.resp, l.person IS NOT NULL AS is_linked
  FROM keys k JOIN customer ON k.person = c_custkey LEFT JOIN linked l ON k.person = l.person
  WHERE k.site NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) AND c_nationkey <> 11 AND (l.person IS NOT NULL OR eligible)),
e AS (SELECT *, coalesce({sql_month('ea')}, {sql_month('eb')}) AS first_enrol FROM j WHERE NOT coalesce(date_diff('day', ea, wa) <= 3, false)),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY person ORDER BY key) = 1),
s AS (SELECT person, key, yob, post_code, sex, CAST(first_enrol AS INTEGER) AS first_enrol, CAST(first_enrol // 3 AS INTEGER) AS first_enrol_q,
    n_regionkey AS area_index, CAST(first_enrol IS NOT NULL AS INTEGER) AS treated, cardio, resp, has_cardio, has_resp, prof.person IS NOT NULL AS profiled, date_death, CAST(2025 - yob AS INTEGER) AS age
  FROM d JOIN nation ON post_code = n_nationkey JOIN dead USING (person) LEFT JOIN prof USING (person) WHERE 2025 - yob >= 18),
u AS (SELECT * FROM s WHERE (profiled OR treated = 1) AND first_enrol_q IS DISTINCT FROM 145),
bound AS (SELECT ceil(avg(age) - 1 * stddev_samp(age)) AS lo FROM u WHERE treated = 1)"""


def study_sample(t: Tables, steps: Attrition | None = None) -> DataFrame:
    """The sample from the given tables: lines as flags, orders as spells, customers as
    persons, nations as areas."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.concat_ws("-", "l_suppkey", "o_custkey").alias("key")
    good = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)
    flags = lines.select(key, F.when(good, "Eligible").otherwise("Other").alias("status"))
    death = F.min(F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 300000),
                         F.col("o_orderdate")))
    deaths = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(death.alias("died"))
    persons = t.customer.join(deaths, "c_custkey", "left").select(
        F.col("c_custkey").alias("o_custkey"), (F.lit(1925) + F.col("c_nationkey") * 3).cast("string").alias("yob"),
        F.when(F.col("c_nationkey") == 11, "Unknown").otherwise(F.col("c_nationkey").cast("string")).alias("post_code"),
        F.col("c_mktsegment").alias("sex"), F.coalesce(F.year("died").cast("string"), F.lit("NULL")).alias("yod"),
        F.coalesce(F.month("died").cast("string"), F.lit("NULL")).alias("mod"))
    # a customer's suppliers leave each map task as one set, which meets the customer where it is put together
    pairs = lines.groupBy("o_custkey").agg(F.collect_set(F.struct("l_suppkey")).alias("pairs"))
    patient = pairs.join(persons, "o_custkey").select("*", F.inline("pairs")).select(
        key, F.col("o_custkey").alias("person"), "yob", "post_code", "sex", "yod", "mod")
    day, urgent = D.to_day("o_orderdate"), F.col("o_orderpriority") == "1-URGENT"
    spells = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.when(urgent, day)).alias("enrolled_1_a"), F.min(F.when(F.col("o_orderpriority") == "2-HIGH", day)).alias("enrolled_1_b"),
        F.min(F.when(urgent & (F.col("o_orderstatus") == "F"), day)).alias("wa"))
    late = (F.col("wa") > F.col("enrolled_1_a")) | (F.month("wa") < 4)
    linked = t.customer.filter("c_mktsegment = 'BUILDING'").join(spells, "c_custkey").select(
        F.col("c_custkey").alias("person"), "enrolled_1_a", "enrolled_1_b", F.when(late, F.date_add("wa", 2)).alias("withdrawn_1_a"),
        (F.col("c_acctbal") > 5000).cast("int").alias("cardio"), (F.col("c_acctbal") < 1000).cast("int").alias("resp"))
    index = t.nation.select(F.col("n_nationkey").alias("post_code"), F.col("n_regionkey").alias("area_index"))
    sites = t.supplier.filter("s_nationkey = 7").select(F.col("s_suppkey").cast("string"))
    params = SP.SampleParams(site_key="key", person="person", status="status", demographics=("yob", "post_code", "sex"), conditions=[("cardio", "has_cardio"), ("resp", "has_resp")],
                             excluded_quarter=D.yq(1996, 2), sd_limit=1)
    return SP.build_sample(flags, patient, linked, index, order_profile(t), params, sites, steps)


@query(f"""
WITH {SAMPLE_SQL}
SELECT person, key, yob, post_code, sex, first_enrol, first_enrol_q, area_index, treated, date_death, age,
  CASE WHEN treated = 0 THEN has_cardio ELSE cardio END AS cardio, CASE WHEN treated = 0 THEN has_resp ELSE resp END AS resp
FROM u, bound WHERE age >= lo""")
def built_sample(t: Tables) -> DataFrame:
    """Treated persons and eligible controls, one row each."""
    return study_sample(t).select("person", "key", "yob", "post_code", "sex", "first_enrol", "first_enrol_q", "area_index", "treated",
                                  "date_death", "age", "cardio", "resp")


@query(f"""
WITH {SAMPLE_SQL}, known AS (SELECT * FROM d JOIN nation ON post_code = n_nationkey WHERE 2025 - yob >= 18)
SELECT CAST(step AS INTEGER) AS step, name, CAST(n AS BIGINT) AS n_rows, CAST(n AS BIGINT) AS n_persons FROM (
  SELECT 1 AS step, 'linked or eligible' AS name, count(*) AS n FROM d
  UNION ALL SELECT 2, 'adults', count(*) FROM d WHERE 2025 - yob >= 18
  UNION ALL SELECT 3, 'known area', count(*) FROM known
  UNION ALL SELECT 4, 'with conditions or treated', count(*) FROM known LEFT JOIN prof USING (person) WHERE prof.person IS NOT NULL OR first_enrol IS NOT NULL
  UNION ALL SELECT 5, 'other start quarters', count(*) FROM u
  UNION ALL SELECT 6, 'trimmed by age', count(*) FROM u, bound WHERE age >= lo)""")
def sample_attrition(t: Tables) -> DataFrame:
    """Persons left after each rule of the study sample, counted while it is built."""
    steps = Attrition("person")
    stable(study_sample(t, steps))
    return steps.table(t.spark)


@query("""
WITH b AS (SELECT o_custkey AS key, o_orderstatus AS born_status, CAST(o_orderdate AS DATE) AS born FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT event_id, key, born_status, strftime(born, '%Y-%m-%d') AS born, event_type FROM events JOIN b ON user_id = key""")
def enriched_roster(t: Tables) -> DataFrame:
    """Two versions of a roster combined, one to many."""
    births = t.orders.select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderstatus").alias("born_status"), D.to_day("o_orderdate").alias("born"))
    spells = t.events.withColumnRenamed("user_id", "key")
    out = rosters.enrich_roster(births, spells, "key", ["born", "o_orderkey"], ["event_id", "key", "born_status", "born", "event_type"])
    return out.withColumn("born", text("born"))


@query("""
SELECT CAST(3000 + n_nationkey AS INTEGER) AS post_code, CAST(n AS VARCHAR) AS population, CAST(n_regionkey AS VARCHAR) AS area_index
FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE n_nationkey BETWEEN 2 AND 20""")
def area_index(t: Tables) -> DataFrame:
    """Area index from a sheet with a heading row: renamed, typed, cut to a range."""
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("string").alias("B"))
    body = t.nation.join(counts, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("n_nationkey") + 3000).cast("string").alias("A"), "B", F.col("n_regionkey").cast("string").alias("C"))
    heading = t.region.select(F.col("r_name").alias("A"), F.lit("Population").alias("B"), F.lit("Score").alias("C"))
    return rosters.clean_area_index(heading.unionByName(body), {"A": "post_code", "B": "population", "C": "area_index"}, low=3002, high=3020)
