"""Queries for matching and the event-study estimator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import did, matching
from ..plans.study import swap_sample
from .base import Tables, query, rounded, sql_rounded
from .panels import ENDS_SQL, FIRST_Q, FIRST_SQL, LAST_Q, PANEL_SQL, first_treatment, followed_panel

CUTS = [0, 1000, 2500, 5000, 7500, 9000]
_BIN = " + ".join(f"(c_acctbal >= {c})::INTEGER" for c in CUTS)


def match_sql(where: str = "true") -> str:
    return f"""
n AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1),
x AS (SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS treated, {_BIN} AS bal, c_nationkey AS nation, n_orders
  FROM customer JOIN n ON c_custkey = o_custkey WHERE {where}),
w AS (SELECT min(n_orders) AS lo, ceil(log2(count(*)) + 1) AS k, (max(n_orders) - min(n_orders)) / ceil(log2(count(*)) + 1) AS step FROM x),
b AS (SELECT x.*, CAST(least(floor((n_orders - lo) / step), k - 1) AS INTEGER) AS nb FROM x, w),
s AS (SELECT bal, nation, nb, sum(treated) AS m_t, sum(1 - treated) AS m_c FROM b GROUP BY ALL),
tot AS (SELECT sum(m_t) AS all_t, sum(m_c) AS all_c FROM s WHERE m_t > 0 AND m_c > 0),
m AS (SELECT b.*, CAST(m_t > 0 AND m_c > 0 AS INTEGER) AS cem_matched, CASE WHEN NOT (m_t > 0 AND m_c > 0) THEN 0.0
    WHEN treated = 1 THEN 1.0 ELSE (all_c / all_t) * m_t / m_c END AS cem_weight FROM b JOIN s USING (bal, nation, nb), tot)"""


def match_input(t: Tables, where: str = "true") -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.filter(where).join(counts, "c_custkey").select(
        "c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"), "c_acctbal",
        F.col("c_nationkey").alias("nation"), "n_orders")


@query(f"WITH {match_sql()} SELECT c_custkey, treated, cem_matched, {sql_rounded('cem_weight')} AS cem_weight FROM m")
def coarsened_matching(t: Tables) -> DataFrame:
    """Coarsened exact matching: cut points, exact and automatic bins, weights."""
    out = matching.cem(match_input(t), "treated", {"c_acctbal": CUTS}, exact=["nation"], auto=["n_orders"])
    return out.select("c_custkey", "treated", "cem_matched", rounded("cem_weight").alias("cem_weight"))


@query(f"""WITH {match_sql()},
i AS (SELECT 'before' AS sample, bal, nation, nb, treated, 1.0 AS wt FROM m UNION ALL SELECT 'after', bal, nation, nb, treated, cem_weight FROM m WHERE cem_matched = 1),
g AS (SELECT sample, bal, nation, nb, sum(wt) FILTER (treated = 1) AS t, sum(wt) FILTER (treated = 0) AS c FROM i GROUP BY ALL),
a AS (SELECT sample, sum(t) AS sum_t, sum(c) AS sum_c FROM g GROUP BY 1)
SELECT sample, {sql_rounded("sum(abs(coalesce(t, 0) / sum_t - coalesce(c, 0) / sum_c)) / 2")} AS l1, CAST(count(*) AS BIGINT) AS n_strata FROM g JOIN a USING (sample) GROUP BY 1""")
def match_imbalance(t: Tables) -> DataFrame:
    """Imbalance before and after matching."""
    out = matching.cem(match_input(t), "treated", {"c_acctbal": CUTS}, exact=["nation"], auto=["n_orders"])
    bins = [c for c in out.columns if c.startswith("bin_")]
    before = matching.imbalance_l1(out, "treated", bins)
    after = matching.imbalance_l1(out.filter("cem_matched = 1"), "treated", bins, "cem_weight")
    both = before.withColumn("sample", F.lit("before")).unionByName(after.withColumn("sample", F.lit("after")))
    return both.select("sample", rounded("l1").alias("l1"), "n_strata")


ATTRIBUTES_SQL = f"""
{PANEL_SQL}, {ENDS_SQL}, {FIRST_SQL},
study AS (SELECT c_custkey AS id, c_nationkey AS cl, q AS t, CAST(coalesce(q - first_q >= -4, false) AS INTEGER) AS d,
  CAST(n_orders AS DOUBLE) AS n_orders, ln(n_orders + 0.1) AS log_orders, CAST(n_lines AS DOUBLE) AS n_lines, c_acctbal > 4500 AS rich,
  CASE WHEN (c_custkey + q) % 3 <> 0 THEN CAST(n_orders AS DOUBLE) END AS seen_orders,
  CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS area FROM kept LEFT JOIN tq USING (c_custkey))"""


def study_panel(t: Tables) -> DataFrame:
    """The censored panel with treatment on from four quarters before the first urgent
    order of a treated person."""
    panel = followed_panel(t).join(first_treatment(t), "c_custkey", "left")
    return panel.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cl"), F.col("q").alias("t"),
        F.coalesce((F.col("q") - F.col("first_q") >= -4).cast("int"), F.lit(0)).alias("d"), "n_orders",
        F.log(F.col("n_orders") + 0.1).alias("log_orders"), "n_lines",
        F.when((F.col("c_custkey") + F.col("q")) % 3 != 0, F.col("n_orders")).alias("seen_orders"), (F.col("c_acctbal") > 4500).alias("rich"),
        F.when(F.col("c_nationkey") < 12, "low").otherwise("high").alias("area"))


def did_sql(models: list[tuple[str, str, str, str]], effects: int, placebo: int, cluster: str = "id", before: str = "") -> str:
    """Brute force by joining units to periods: `models` is (outcome, spec, subgroup, condition),
    `before` names further tables for the conditions."""
    rows = " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, '{s}' AS spec, {g} AS subgroup, id, {cluster} AS cl, t, d, {o} AS y FROM study WHERE {c}"
        for o, s, g, c in models)
    return f"""
WITH {ATTRIBUTES_SQL},{before}
pm AS ({rows}),
f0 AS (SELECT outcome, spec, subgroup, id, any_value(cl) AS cl, arg_min(d, t) AS d1 FROM pm GROUP BY ALL),
un AS (SELECT f0.outcome, f0.spec, f0.subgroup, f0.id, f0.cl, f0.d1, min(t) FILTER (d <> d1) AS f, sign(arg_min(d, t) FILTER (d <> d1) - any_value(d1)) AS s
  FROM f0 JOIN pm USING (outcome, spec, subgroup, id) GROUP BY f0.outcome, f0.spec, f0.subgroup, f0.id, f0.cl, f0.d1),
gr AS (SELECT sf, l, sf - 1 AS t1, sf - 1 + l AS t2, sf - 1 + abs(l) AS til FROM (SELECT unnest(range({FIRST_Q} + 1, {LAST_Q} + 1)) AS sf),
  (SELECT unnest(range(-{placebo}, {effects} + 1)) AS l) WHERE l <> 0 AND sf - 1 + l BETWEEN {FIRST_Q} AND {LAST_Q} AND sf - 1 + abs(l) <= {LAST_Q}),
ob AS (SELECT un.*, gr.sf, gr.l, coalesce(un.f = gr.sf, false) AS sw, b.y - a.y AS dy, abs(b.d - un.d1) AS dose
  FROM gr JOIN un ON un.f = gr.sf OR un.f IS NULL OR un.f > gr.til
  JOIN pm a ON a.outcome = un.outcome AND a.spec = un.spec AND a.subgroup = un.subgroup AND a.id = un.id AND a.t = gr.t1
  JOIN pm b ON b.outcome = un.outcome AND b.spec = un.spec AND b.subgroup = un.subgroup AND b.id = un.id AND b.t = gr.t2
  LEFT JOIN pm e ON e.outcome = un.outcome AND e.spec = un.spec AND e.subgroup = un.subgroup AND e.id = un.id AND e.t = gr.til
  WHERE b.y - a.y IS NOT NULL AND (NOT coalesce(un.f = gr.sf, false) OR gr.l > 0 OR e.y IS NOT NULL)),
c0 AS (SELECT outcome, spec, subgroup, d1, sf, l, count(*) FILTER (sw) AS ns, coalesce(sum(s) FILTER (sw), 0) AS ss, coalesce(sum(s * dy) FILTER (sw), 0) AS dys,
  coalesce(sum(dy) FILTER (sw), 0) AS dyr, sum(dose) FILTER (sw) AS dose, count(*) FILTER (NOT sw) AS nc, sum(dy) FILTER (NOT sw) AS dyc FROM ob GROUP BY ALL HAVING ns > 0 AND nc > 0),
ce AS (SELECT * FROM c0 WHERE l > 0 OR EXISTS (SELECT 1 FROM c0 z WHERE z.outcome = c0.outcome AND z.spec = c0.spec AND z.subgroup = c0.subgroup
  AND z.d1 = c0.d1 AND z.sf = c0.sf AND z.l = -c0.l)),
es AS (SELECT outcome, spec, subgroup, l, sum(dys - ss * dyc / nc) AS total, sum(ns) AS n_switchers, sum(ns + nc) AS n_obs, sum(dose) AS dose FROM ce GROUP BY ALL),
av AS (SELECT outcome, spec, subgroup, 0 AS l, sum(total) AS total, sum(n_switchers) AS n_switchers, sum(n_obs) AS n_obs, sum(dose) AS dose FROM es WHERE l > 0 GROUP BY ALL),
co AS (SELECT outcome, spec, subgroup, d1, sf, l, s, count(*) AS n, sum(dy) AS sdy FROM ob WHERE sw GROUP BY ALL),
iv AS (SELECT ob.outcome, ob.spec, ob.subgroup, ob.cl, ob.l, CASE WHEN sw
    THEN ob.s * CASE WHEN co.n > 1 THEN sqrt(co.n / (co.n - 1.0)) * (dy - co.sdy / co.n) ELSE sqrt((1.0 + ce.nc) / ce.nc) * (dy - (co.sdy + ce.dyc) / (1 + ce.nc)) END
    ELSE -ce.ss / ce.nc * CASE WHEN ce.nc > 1 THEN sqrt(ce.nc / (ce.nc - 1.0)) * (dy - ce.dyc / ce.nc) ELSE sqrt((1.0 + ce.ns) / ce.ns) * (dy - (ce.dyc + ce.dyr) / (1 + ce.ns)) END END AS u
  FROM ob JOIN ce USING (outcome, spec, subgroup, d1, sf, l) LEFT JOIN co USING (outcome, spec, subgroup, d1, sf, l, s)),
uc AS (SELECT iv.outcome, iv.spec, iv.subgroup, iv.cl, iv.l, sum(u) / any_value(n_switchers) AS u, sum(u) AS raw
  FROM iv JOIN es USING (outcome, spec, subgroup, l) GROUP BY iv.outcome, iv.spec, iv.subgroup, iv.cl, iv.l),
ua AS (SELECT uc.outcome, uc.spec, uc.subgroup, uc.cl, 0 AS l, sum(raw) / any_value(av.dose) AS u FROM uc JOIN av USING (outcome, spec, subgroup)
  WHERE uc.l > 0 GROUP BY uc.outcome, uc.spec, uc.subgroup, uc.cl),
se AS (SELECT outcome, spec, subgroup, l, sqrt(sum(u * u)) AS se FROM (SELECT outcome, spec, subgroup, l, u FROM uc UNION ALL SELECT outcome, spec, subgroup, l, u FROM ua) GROUP BY ALL),
fin AS (SELECT *, total / n_switchers AS est FROM es UNION ALL SELECT *, total / dose FROM av)"""


RESULT_SQL = f"""
SELECT outcome, spec, subgroup, CASE WHEN l > 0 THEN 'effect' WHEN l < 0 THEN 'placebo' ELSE 'average' END AS kind, CAST(abs(l) AS INTEGER) AS horizon,
  {sql_rounded('est')} AS estimate, {sql_rounded('se')} AS se, {sql_rounded(f'est - {did.Z95} * se')} AS ci_low,
  {sql_rounded(f'est + {did.Z95} * se')} AS ci_high, CAST(n_switchers AS BIGINT) AS n_switchers, CAST(n_obs AS BIGINT) AS n_obs
FROM fin LEFT JOIN se USING (outcome, spec, subgroup, l)"""


def shown(results: DataFrame) -> DataFrame:
    return results.withColumns({c: rounded(c) for c in ("estimate", "se", "ci_low", "ci_high")})


@query(did_sql([("n_orders", "baseline", "'all'", "true")], 10, 5) + RESULT_SQL)
def event_study(t: Tables) -> DataFrame:
    """Ten effects, five placebos and the average effect with errors (C20)."""
    return shown(did.did_dynamic(study_panel(t), "n_orders", "id", "t", "d", 10, 5, cluster="id", periods=(FIRST_Q, LAST_Q)))


@query(did_sql([("n_lines", "baseline", "'all'", "true")], 6, 3, "cl") + RESULT_SQL)
def event_study_clustered(t: Tables) -> DataFrame:
    """Errors clustered above the unit (C20)."""
    return shown(did.did_dynamic(study_panel(t), "n_lines", "id", "t", "d", 6, 3, cluster="cl", periods=(FIRST_Q, LAST_Q)))


@query(did_sql([("seen_orders", "baseline", "'all'", "true")], 6, 3) + RESULT_SQL)
def event_study_with_gaps(t: Tables) -> DataFrame:
    """An outcome that is missing in a third of the rows (C20)."""
    return shown(did.did_dynamic(study_panel(t), "seen_orders", "id", "t", "d", 6, 3, cluster="id", periods=(FIRST_Q, LAST_Q)))


@query(did_sql([("n_orders", "area", "area", "true")], 6, 3) + RESULT_SQL)
def event_study_by_group(t: Tables) -> DataFrame:
    """The same by subgroup."""
    return shown(did.did_dynamic(study_panel(t), "n_orders", "id", "t", "d", 6, 3, by="area", periods=(FIRST_Q, LAST_Q)))


@query(did_sql([("log_orders", "baseline", "'all'", "rich")], 6, 3) + RESULT_SQL)
def event_study_subset(t: Tables) -> DataFrame:
    """A logged outcome on a filtered subset."""
    return shown(did.did_dynamic(study_panel(t), "log_orders", "id", "t", "d", 6, 3, where=F.col("rich"), periods=(FIRST_Q, LAST_Q)))


BATCH = ["n_orders", "log_orders", "n_lines"]


@query(did_sql([m for o in BATCH for m in ((o, "baseline", "'all'", "true"), (o, "area", "area", "true"), (o, "rich", "'all'", "rich"))], 4, 2) + RESULT_SQL)
def event_study_batch(t: Tables) -> DataFrame:
    """Outcomes by specifications in one job."""
    specs = {"baseline": {}, "area": {"by": "area"}, "rich": {"where": F.col("rich")}}
    return shown(did.did_batch(study_panel(t), BATCH, "id", "t", "d", 4, 2, specs=specs, periods=(FIRST_Q, LAST_Q)))


@query(did_sql([("n_orders", "baseline", "'all'", "true"), ("n_orders", "area", "area", "true")], 2, 2) + f""",
pr AS (SELECT a.outcome, a.spec, a.subgroup, CASE WHEN a.l > 0 THEN 'effect' ELSE 'placebo' END AS kind, sum(a.u * a.u) FILTER (abs(a.l) = 1 AND b.l = a.l) AS v11,
  sum(a.u * a.u) FILTER (abs(a.l) = 2 AND b.l = a.l) AS v22, sum(a.u * b.u) FILTER (abs(a.l) = 1 AND abs(b.l) = 2) AS v12
  FROM uc a JOIN uc b ON a.outcome = b.outcome AND a.spec = b.spec AND a.subgroup = b.subgroup AND a.cl = b.cl AND a.l * b.l > 0 GROUP BY ALL),
pe AS (SELECT outcome, spec, subgroup, CASE WHEN l > 0 THEN 'effect' ELSE 'placebo' END AS kind, max(est) FILTER (abs(l) = 1) AS e1, max(est) FILTER (abs(l) = 2) AS e2
  FROM fin WHERE l <> 0 GROUP BY ALL),
ch AS (SELECT *, (e1 * e1 * v22 - 2 * e1 * e2 * v12 + e2 * e2 * v11) / (v11 * v22 - v12 * v12) AS chi2 FROM pr JOIN pe USING (outcome, spec, subgroup, kind))
SELECT outcome, spec, subgroup, kind, CAST(2 AS INTEGER) AS df, {sql_rounded('chi2')} AS chi2, {sql_rounded('exp(-chi2 / 2)')} AS p_value FROM ch""")
def event_study_joint_tests(t: Tables) -> DataFrame:
    """Wald tests that all effects, and all placebos, are zero (C20)."""
    out = did.did_joint_tests(study_panel(t), ["n_orders"], "id", "t", "d", 2, 2, specs={"baseline": {}, "area": {"by": "area"}},
                              periods=(FIRST_Q, LAST_Q))
    return out.withColumns({"chi2": rounded("chi2"), "p_value": rounded("p_value")})


THREE_SEGMENTS = "c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"


@query(did_sql([("n_orders", "baseline", "'all'", "id IN (SELECT c_custkey FROM m WHERE cem_matched = 1)")], 6, 3,
               before=match_sql(THREE_SEGMENTS) + ",") + RESULT_SQL)
def matched_event_study(t: Tables) -> DataFrame:
    """The event study on the matched sample: other segments leave before the matching, and the
    panel keeps the persons that it matched (C8, C9, C20)."""
    people = matching.cem(match_input(t, THREE_SEGMENTS), "treated", {"c_acctbal": CUTS}, exact=["nation"], auto=["n_orders"])
    matched = people.filter("cem_matched = 1").withColumnRenamed("c_custkey", "id")
    panel = swap_sample(study_panel(t), matched, "id")
    return shown(did.did_dynamic(panel, "n_orders", "id", "t", "d", 6, 3, cluster="id", periods=(FIRST_Q, LAST_Q)))


REPLICATES = 20
_WEIGHT = " + ".join(f"(u >= {p!r})::INTEGER" for p in did.POISSON)


@query(did_sql([("n_orders", "baseline", "'all'", "true"), ("n_orders", "area", "area", "true")], 3, 2) + f""",
bw AS (SELECT cl, b, {_WEIGHT} AS w FROM (SELECT cl, b, CAST('0x' || substr(md5('1:' || cl || ':' || b), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT cl FROM un), (SELECT unnest(range({REPLICATES})) AS b))),
cb AS (SELECT outcome, spec, subgroup, d1, sf, l, b, sum(w) FILTER (sw) AS ns, sum(s * w) FILTER (sw) AS ss, sum(s * dy * w) FILTER (sw) AS dys,
  sum(dose * w) FILTER (sw) AS dose, sum(w) FILTER (NOT sw) AS nc, sum(dy * w) FILTER (NOT sw) AS dyc FROM ob JOIN bw USING (cl) GROUP BY ALL HAVING ns > 0 AND nc > 0),
cu AS (SELECT * FROM cb WHERE l > 0 OR EXISTS (SELECT 1 FROM cb z WHERE z.outcome = cb.outcome AND z.spec = cb.spec AND z.subgroup = cb.subgroup
  AND z.d1 = cb.d1 AND z.sf = cb.sf AND z.b = cb.b AND z.l = -cb.l)),
eb AS (SELECT outcome, spec, subgroup, b, l, sum(dys - ss * dyc / nc) / sum(ns) AS est FROM cu GROUP BY ALL
  UNION ALL SELECT outcome, spec, subgroup, b, 0, sum(dys - ss * dyc / nc) / sum(dose) FROM cu WHERE l > 0 GROUP BY ALL),
sb AS (SELECT outcome, spec, subgroup, l, stddev_samp(est) AS se, count(est) AS n_replicates FROM eb GROUP BY ALL)
SELECT outcome, spec, subgroup, CASE WHEN l > 0 THEN 'effect' WHEN l < 0 THEN 'placebo' ELSE 'average' END AS kind, CAST(abs(l) AS INTEGER) AS horizon,
  {sql_rounded('est')} AS estimate, {sql_rounded('se')} AS se, CAST(coalesce(n_replicates, 0) AS BIGINT) AS n_replicates
FROM fin LEFT JOIN sb USING (outcome, spec, subgroup, l)""")
def event_study_bootstrap(t: Tables) -> DataFrame:
    """Errors by a bootstrap of persons, all replicates in one pass over the cells (C20)."""
    out = did.did_bootstrap(study_panel(t), ["n_orders"], "id", "t", "d", 3, 2, specs={"baseline": {}, "area": {"by": "area"}},
                            periods=(FIRST_Q, LAST_Q), replicates=REPLICATES)
    return out.withColumns({"estimate": rounded("estimate"), "se": rounded("se")})
