"""The event-study estimator against a plain computation over all pairs of units."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort_engine.operators import did

PERIODS = 12


def simulate(n: int, seed: int, noise: float = 1.0, effect: float = 0.5, gaps: bool = True) -> pd.DataFrame:
    """Staggered switchers up and down, units on from the start, never switched ones,
    early exits and missing outcomes."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        first = int(rng.choice([0, 0, 0, 1, 3, 5, 6, 9]))
        level, down = rng.normal(), i % 9 == 4
        last = PERIODS if i % 5 or not gaps else int(rng.integers(6, PERIODS + 1))
        for t in range(1, last + 1):
            on = int(first > 0 and t >= first)
            d = 1 - on if down else on
            shift = effect * (t - first + 1) * on * (-1 if down else 1) * (first > 1)
            y = level + 0.3 * t + shift + noise * rng.normal()
            data.append((i, t, d, None if gaps and rng.random() < 0.05 else y, i // 3, "ab"[i % 2]))
    return pd.DataFrame(data, columns=["id", "t", "d", "y", "cl", "g"])


def brute_force(df: pd.DataFrame, effects: int, placebo: int, cluster: str = "id"):
    y = df.pivot(index="id", columns="t", values="y").reindex(columns=range(1, PERIODS + 1)).astype(float)
    d = df.pivot(index="id", columns="t", values="d").reindex(columns=range(1, PERIODS + 1)).astype(float)
    group = df.groupby("id")[cluster].first() if cluster != "id" else pd.Series(y.index, index=y.index)
    start, switch, sign = {}, {}, {}
    for i in y.index:
        known = d.loc[i].dropna()
        start[i] = known.iloc[0]
        changed = known[known != known.iloc[0]]
        switch[i] = int(changed.index[0]) if len(changed) else None
        sign[i] = float(np.sign(changed.iloc[0] - known.iloc[0])) if len(changed) else 0.0
    cells = {}
    for l in [*range(1, effects + 1), *range(-placebo, 0)]:
        for f in range(2, PERIODS + 1):
            a, b, until = f - 1, f - 1 + l, f - 1 + abs(l)
            if b < 1 or until > PERIODS:
                continue
            for base in (0.0, 1.0):
                seen = [i for i in y.index if start[i] == base and not math.isnan(y.loc[i, a]) and not math.isnan(y.loc[i, b])]
                sw = [i for i in seen if switch[i] == f and (l > 0 or not math.isnan(y.loc[i, until]))]
                co = [i for i in seen if switch[i] is None or switch[i] > until]
                if sw and co:
                    cells[(l, f, base)] = (sw, co, {i: y.loc[i, b] - y.loc[i, a] for i in sw + co},
                                           sum(abs(d.loc[i, b] - base) for i in sw))
    cells = {k: v for k, v in cells.items() if k[0] > 0 or (-k[0], k[1], k[2]) in cells}
    total, count, dose, scores = {}, {}, {}, {}
    for (l, f, base), (sw, co, dy, gained) in cells.items():
        mean_c = np.mean([dy[i] for i in co])
        value = sum(sign[i] * (dy[i] - mean_c) for i in sw)
        for h in (l, 0) if l > 0 else (l,):
            total[h] = total.get(h, 0) + value
            count[h] = count.get(h, 0) + len(sw)
            dose[h] = dose.get(h, 0) + gained
            u = scores.setdefault(h, {})
            whole = list(dy.values())  # a group of one is centred on the whole cell
            of_s, of_c = ([dy[i] for i in g] if len(g) > 1 else whole for g in (sw, co))
            for i in sw:
                centred = math.sqrt(len(of_s) / (len(of_s) - 1)) * (dy[i] - np.mean(of_s))
                u[group[i]] = u.get(group[i], 0) + sign[i] * centred
            for i in co:
                centred = math.sqrt(len(of_c) / (len(of_c) - 1)) * (dy[i] - np.mean(of_c))
                u[group[i]] = u.get(group[i], 0) - sum(sign[j] for j in sw) / len(co) * centred
    out = {}
    for h in total:
        per = dose[h] if h == 0 else count[h]
        out[h] = (total[h] / per, math.sqrt(sum(u * u for u in scores[h].values())) / per, count[h])
    return out


def by_horizon(results, **where):
    sign = {"effect": 1, "placebo": -1, "average": 0}
    return {sign[r["kind"]] * r["horizon"]: r for r in results if all(r[k] == v for k, v in where.items())}


@pytest.fixture(scope="module")
def panel():
    return simulate(120, 1)


@pytest.mark.parametrize("cluster", ["id", "cl"])
def test_equals_brute_force(spark, panel, cluster):
    got = by_horizon(did.did_dynamic(spark.createDataFrame(panel), "y", "id", "t", "d", 6, 3, cluster=cluster).collect())
    want = brute_force(panel, 6, 3, cluster)
    assert set(got) == set(want)
    for h, (estimate, se, switchers) in want.items():
        assert got[h]["estimate"] == pytest.approx(estimate, abs=1e-10)
        assert got[h]["se"] == pytest.approx(se, abs=1e-10)
        assert got[h]["n_switchers"] == switchers


def test_batch_equals_single_runs(spark, panel):
    df = spark.createDataFrame(panel).withColumn("z", F.col("y") * 2 + F.col("t"))
    specs = {"baseline": {}, "g": {"by": "g"}, "only_a": {"where": F.col("g") == "a"}}
    rows = did.did_batch(df, ["y", "z"], "id", "t", "d", 3, 2, specs=specs).collect()
    for part, where in (("a", {"spec": "g", "subgroup": "a"}), ("a", {"spec": "only_a"}), (None, {"spec": "baseline"})):
        want = brute_force(panel if part is None else panel[panel.g == part], 3, 2)
        for outcome, factor in (("y", 1), ("z", 2)):
            got = by_horizon(rows, outcome=outcome, **where)
            assert set(got) == set(want)
            for h, (estimate, se, _) in want.items():
                assert got[h]["estimate"] == pytest.approx(factor * estimate, abs=1e-9)
                assert got[h]["se"] == pytest.approx(factor * se, abs=1e-9)


def test_additive_outcome_has_no_effect(spark):
    df = simulate(60, 2, noise=0.0, effect=0.0, gaps=False)
    rows = did.did_dynamic(spark.createDataFrame(df), "y", "id", "t", "d", 4, 3).collect()
    assert len(rows) == 8 and all(abs(r["estimate"]) < 1e-9 for r in rows)


def test_known_effect_is_recovered(spark):
    df = simulate(400, 3, noise=0.1, effect=0.5, gaps=False)
    got = by_horizon(did.did_dynamic(spark.createDataFrame(df), "y", "id", "t", "d", 4, 2).collect())
    for l in range(1, 5):
        assert abs(got[l]["estimate"] - 0.5 * l) < 4 * got[l]["se"] < 0.2
    for l in (-1, -2):
        assert abs(got[l]["estimate"]) < 4 * got[l]["se"]


def test_no_controls_leaves_nothing(spark):
    df = simulate(40, 4, gaps=False)
    switched = df[df.groupby("id")["d"].transform("nunique") > 1].copy()
    one_cohort = switched[switched.groupby("id")["d"].transform("sum") == 10]
    assert did.did_dynamic(spark.createDataFrame(one_cohort), "y", "id", "t", "d", 2, 1).collect() == []


@pytest.mark.parametrize("partitions", [1, 50])
def test_partitions_do_not_matter(spark, panel, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(panel).repartition(partitions, "t")
        got = by_horizon(did.did_dynamic(df, "y", "id", "t", "d", 2, 1).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for h, (estimate, se, _) in brute_force(panel, 2, 1).items():
        assert got[h]["estimate"] == pytest.approx(estimate, abs=1e-10) and got[h]["se"] == pytest.approx(se, abs=1e-10)


def test_repeated_periods_and_varying_columns_fail(spark, panel):
    unit = panel["id"].iloc[0]
    df = spark.createDataFrame(panel)
    twice = df.unionByName(df.filter((F.col("id") == int(unit)) & (F.col("t") == int(panel["t"].min()))))
    gap = twice.filter(~((F.col("id") == int(unit)) & (F.col("t") == int(panel["t"].max()))))
    for bad in (twice, gap):
        with pytest.raises(Exception, match="a period twice"):
            did.did_dynamic(bad, "y", "id", "t", "d", 2, 1).collect()
    varying = df.withColumn("g", F.when(F.col("t") > int(panel["t"].min()), "b").otherwise("a"))
    for kwargs in ({"by": "g"}, {"cluster": "g"}, {"where": F.col("g") == "a"}):
        with pytest.raises(Exception, match="varies within a unit"):
            did.did_dynamic(varying, "y", "id", "t", "d", 2, 1, **kwargs).collect()
    lost = df.unionByName(df.withColumn("id", F.lit(None).cast(df.schema["id"].dataType)))
    want = by_horizon(did.did_dynamic(df, "y", "id", "t", "d", 2, 1).collect())
    got = by_horizon(did.did_dynamic(lost, "y", "id", "t", "d", 2, 1).collect())
    assert all(got[h]["estimate"] == pytest.approx(want[h]["estimate"]) for h in want)


def test_missing_outcomes_do_not_multiply_cells(spark, panel):
    df = spark.createDataFrame(panel).withColumn("y", F.when(F.xxhash64("id", "t") % 3 != 0, F.col("y")))
    full = did.DidPlan(spark.createDataFrame(panel), ["y"], "id", "t", "d", 2, 1, None, None, None)
    thin = did.DidPlan(df, ["y"], "id", "t", "d", 2, 1, None, None, None)
    assert 0 < thin.stats.count() <= full.stats.count() <= 2 * PERIODS * 3
    got = by_horizon(did.did_dynamic(df, "y", "id", "t", "d", 2, 1).collect())
    for h, (estimate, se, _) in brute_force(df.toPandas(), 2, 1).items():
        assert got[h]["estimate"] == pytest.approx(estimate, abs=1e-10) and got[h]["se"] == pytest.approx(se, abs=1e-10)


def test_without_broadcast(spark, panel):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = by_horizon(did.did_dynamic(spark.createDataFrame(panel), "y", "id", "t", "d", 2, 1).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for h, (estimate, se, _) in brute_force(panel, 2, 1).items():
        assert got[h]["se"] == pytest.approx(se, abs=1e-10)


@pytest.mark.parametrize("x,k,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
                                   (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (15.0863, 5, 0.01)])
def test_chi_squared_tail(x, k, p):
    assert did._chi2_upper(x, k) == pytest.approx(p, abs=1e-6)


def test_joint_test_of_one_horizon_is_a_squared_ratio(spark, panel):
    df = spark.createDataFrame(panel)
    tests = {r["kind"]: r for r in did.did_joint_tests(df, ["y"], "id", "t", "d", 1, 1).collect()}
    single = by_horizon(did.did_dynamic(df, "y", "id", "t", "d", 1, 1).collect())
    for kind, h in (("effect", 1), ("placebo", -1)):
        assert tests[kind]["df"] == 1
        assert tests[kind]["chi2"] == pytest.approx((single[h]["estimate"] / single[h]["se"]) ** 2)


def test_bootstrap_replicates_are_weighted_panels(spark):
    """Each replicate equals the plain estimate on a panel in which every cluster's units stand as often as it weighs."""
    df = simulate(90, 4)
    panel = spark.createDataFrame(df)
    units = did.unit_models(did.unit_profiles(panel, ["y"], "id", "t", "d", "cl", {"g": {"by": "g"}}, (1, PERIODS)), ["y"])
    cells = did.unit_cells(units, 3, 2, (1, PERIODS)).repartition(5)
    model = [*did.MODEL, "replicate"]
    draws = did._estimates(did.cell_stats(did.weighted_cells(cells, 4, 1), model, F.col("n")), model).collect()
    got = {(r["replicate"], r["subgroup"], r["l"]): r["estimate"] for r in draws}
    want = {}
    for b in range(4):
        weights = {c: did.poisson_weights(str(c), 4, 1)[b] for c in df["cl"].unique()}
        copies = pd.concat([df[df["cl"].map(weights) > k].assign(id=lambda x: x["id"].astype(str) + f"-{k}") for k in range(max(weights.values()))])
        for r in did.did_batch(spark.createDataFrame(copies), ["y"], "id", "t", "d", 3, 2, specs={"g": {"by": "g"}}, periods=(1, PERIODS), errors=False).collect():
            want[b, r["subgroup"], r["horizon"] * (-1 if r["kind"] == "placebo" else 1)] = r["estimate"]
    assert got.keys() == want.keys() and len(got) > 40
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_bootstrap_agrees_with_the_analytic_errors(spark):
    panel = spark.createDataFrame(simulate(900, 6, gaps=False))
    boot = did.did_bootstrap(panel, ["y"], "id", "t", "d", 3, 1, cluster="cl", replicates=600).collect()
    plain = {(r["kind"], r["horizon"]): r for r in did.did_batch(panel, ["y"], "id", "t", "d", 3, 1, cluster="cl").collect()}
    assert len(boot) == len(plain) == 5
    for r in boot:
        assert r["estimate"] == pytest.approx(plain[r["kind"], r["horizon"]]["estimate"]) and r["n_replicates"] == 600
        assert r["se"] == pytest.approx(plain[r["kind"], r["horizon"]]["se"], rel=0.1)


def test_bootstrap_by_cohorts_equals_that_by_cells(spark, monkeypatch):
    """Replicates of cohorts, also if a task gives out its sums often, are those of the units' cells; where cohorts are few no
    unit is laid out over the cells."""
    panel = spark.createDataFrame(simulate(120, 4, gaps=False)).withColumn("y", F.when((F.col("id") % 4 > 0) | (F.col("t") != 7), F.col("y")))
    units = did.unit_models(did.unit_profiles(panel, ["y"], "id", "t", "d", "cl", {"g": {"by": "g"}, "all": {}}, (1, PERIODS)), ["y"]).repartition(5)
    model = [*did.MODEL, "replicate"]

    def estimates(cells):
        rows = did._estimates(did.cell_stats(cells, model, F.col("n")), model).collect()
        return {tuple(r[c] for c in [*model, "l"]): r["estimate"] for r in rows}

    want = estimates(did.weighted_cells(did.unit_cells(units, 3, 2, (1, PERIODS)), 4, 1))
    for held in (did.HELD, 0):
        got = estimates(did.unit_cells(did.weighted_cohorts(units, PERIODS, 4, 1, held), 3, 2, (1, PERIODS)))
        assert got.keys() == want.keys() and len(got) > 50
        assert all(got[k] == pytest.approx(want[k]) for k in got)

    def shown(few):
        monkeypatch.setattr(did, "FEW", few)
        out = did.did_bootstrap(panel, ["y"], "id", "t", "d", 3, 2, cluster="cl", specs={"g": {"by": "g"}}, replicates=4).collect()
        return {(r["subgroup"], r["kind"], r["horizon"], r["n_replicates"]): (r["estimate"], r["se"]) for r in out}

    by_cells = shown(10**9)
    monkeypatch.setattr(did, "weighted_cells", None)
    by_cohorts = shown(1)
    assert by_cohorts.keys() == by_cells.keys()
    assert all(by_cohorts[k] == pytest.approx(by_cells[k]) for k in by_cells)
