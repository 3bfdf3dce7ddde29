"""Row, group and merge operators on edge frames."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cohort_engine.operators import collapse as C, filters as FL, keys as K, linkage as L, merge as M
from cohort_engine.operators import matching, ordering as O, projections as P, report, windows as W
from cohort_engine.session import stable
from conftest import rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, "c", 7), (2, "d", 8)], "k int, x string, sh int")
    right = spark.createDataFrame([(1, "A", 50), (None, "N", 70), (3, "Z", 90)], "k int, y string, sh int")
    return left, right


FULL = [(1, "a", 5, "A", 3), (1, "b", 6, "A", 3), (2, "d", 8, None, 1), (3, None, 90, "Z", 2), (None, "c", 7, "N", 3)]


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_merge_statuses_null_keys_and_shared_columns(sides):
    left, right = sides
    assert as_set(M.merge_tables(left, right, "k", "m:1", validate=True)) == set(FULL)


@pytest.mark.parametrize("keep", [(1,), (2,), (3,), (1, 3), (2, 3), (1, 2), (1, 2, 3)])
def test_merge_keeps_are_parts_of_the_full_merge(sides, keep):
    left, right = sides
    want = {r for r in FULL if r[-1] in keep}
    assert as_set(M.merge_tables(left, right, "k", "m:1", keep=keep)) == want
    # the mirrored merge has the same matches
    mirrored = M.merge_tables(right, left, "k", "1:m", keep=[{1: 2, 2: 1, 3: 3}[k] for k in keep])
    got = {(r["k"], r["x"], r["y"], {1: 2, 2: 1, 3: 3}[r["_merge"]]) for r in mirrored.collect()}
    assert got == {(k, x, y, m) for k, x, sh, y, m in want}
    single = left.filter("x <> 'b'")
    got = as_set(M.merge_tables(single, right, "k", "1:1", keep=keep))
    assert got == {r for r in want if r[1] != "b"}


def test_merge_kind_is_checked(sides):
    left, right = sides
    with pytest.raises(Exception, match="not unique"):
        M.merge_tables(left, right, "k", "1:1", validate=True).collect()
    with pytest.raises(ValueError):
        M.merge_tables(left, right, "k", "m:m")
    assert M.is_unique(right, "k") and not M.is_unique(left, "k")


def test_split_and_conditional_retention(sides):
    left, right = sides
    matched, left_only, right_only = M.split_match(left, right, "k", "m:1")
    assert matched.count() == 3 and rows(left_only) == [(2, "d", 8)] and rows(right_only) == [(3, "Z", 90)]
    kept = M.merge_keep_or(left, right.filter("k = 1"), "k", F.col("x") == "d", using=["y"])
    assert as_set(kept) == {(1, "a", 5, "A"), (1, "b", 6, "A"), (2, "d", 8, None)}


def test_append_and_align(spark):
    a = spark.createDataFrame([(1, "x")], "n bigint, t string")
    b = spark.createDataFrame([("2", 3.0)], "n string, extra double")
    both = M.append(a, M.align_types(b, a))
    assert both.dtypes[0] == ("n", "bigint") and as_set(both) == {(1, "x", None), (2, None, 3.0)}


def test_filters(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, 1), (3, None)], "k int, v int")
    assert FL.drop_if(df, F.col("v") > 2).count() == 3 and FL.keep_if(df, F.col("v") > 2).count() == 1
    assert rows(FL.keep_groups_any(df, "k", F.col("v") == 5)) == [(1, None), (1, 5)]
    nulls = spark.createDataFrame([(None, 1), (None, 2), (7, 3), (None, 4)], "k int, v int").withColumn("j", F.lit(1))
    assert rows(FL.keep_unique_keys(nulls, ["k", "j"])) == [(7, 3, 1)]
    assert rows(FL.keep_unique_keys(nulls.filter("v <> 2 AND v <> 4"), ["k", "j"])) == [(None, 1, 1), (7, 3, 1)]
    panel = spark.createDataFrame([(q, e) for e in (None, 2, 0) for q in (1, 2, 3)], "q int, e int")
    assert rows(FL.censor_after(panel, "q", "e", 1)) == [(1, None), (1, 2), (2, None), (3, None)]


def test_trim_keeps_missing_by_a_lower_bound(spark):
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate([(60, 1), (70, 1), (80, 1), (40, 0), (None, 0), (75, 0)])], "id int, age int, t int")
    kept = {r["age"] for r in FL.trim_by_sd(df, "age", "id", F.col("t") == 1, k=1).collect()}
    assert kept == {60, 70, 80, 75, None}  # mean 70, sd 10
    kept = {r["age"] for r in FL.trim_by_sd(df, "age", "id", F.col("t") == 1, k=1, lower=False).collect()}
    assert kept == {60, 70, 80, 40, 75}


def test_collapse_and_distinct(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, "a"), (2, 3, "a"), (2, None, "a")], "k int, v int, e string")
    assert rows(C.collapse_sum(df, "k", ["v"])) == [(1, 0), (2, 3)]
    assert rows(C.n_distinct(df, "k", {"n": "e"})) == [(1, 2), (2, 1)]
    assert rows(C.any_by(df, "k", {"big": F.col("v") > 2})) == [(1, 0), (2, 1)]
    # a group of only missing values has a missing minimum
    assert rows(df.groupBy("k").agg(F.min("v"))) == [(1, None), (2, 3)]


def test_month_sums_then_quarter_sums_equal_quarter_sums(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randint(1, 5), rnd.randint(744, 788), rnd.randint(0, 9)) for _ in range(500)], "k int, m int, v int")
    direct = C.collapse_sum(df.withColumn("q", F.floor(F.col("m") / 3).cast("int")), ["k", "q"], ["v"])
    assert rows(C.rollup_periods(df, "k", "m", ["v"])) == rows(direct)


def test_distinct_entities_are_merged_from_one_pass(spark):
    rnd = random.Random(9)
    data = [(rnd.randint(1, 3), rnd.randint(740, 790), rnd.choice([None, *range(1, 90_000, 700)])) for _ in range(4_000)]
    df = spark.createDataFrame(data, "k int, m int, e long")
    out = C.distinct_by_period(df, "k", "m", "e")
    want = {}
    for k, m, e in data:
        for unit, months in (("month", 1), ("quarter", 3), ("year", 12)):
            want.setdefault((k, unit, m // months), set()).add(e)
    assert {(r["k"], r["unit"], r["period"]): r["n"] for r in out.collect()} == {k: len(v) for k, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") >= 2  # events are grouped by month once


def test_sequence_puts_missing_last_and_survives_hot_groups(spark):
    data = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else i * 37 % 101) for i in range(600)]
    df = spark.createDataFrame(data, "id int, k string, d int")
    want = {}
    groups: dict = {}
    for i, k, d in data:
        groups.setdefault(k, []).append((d is None, d or 0, i))
    for k, items in groups.items():
        for n, (_, _, i) in enumerate(sorted(items), 1):
            want[i] = n
    assert {r["id"]: r["seq"] for r in W.seq_in_group(df, "k", ["d", "id"]).collect()} == want
    first = {r["id"] for r in W.first_flag(df, "k", ["d", "id"]).filter("first = 1").collect()}
    assert first == {i for i, n in want.items() if n == 1}
    assert {r["id"] for r in W.first_in_group(df, "k", ["d", "id"]).collect()} == first
    top = {r["id"]: r["seq"] for r in W.first_k(df, "k", ["d", "id"], 3).collect()}
    assert top == {i: n for i, n in want.items() if n <= 3}
    many = {r["id"]: r["seq"] for r in W.first_k(df, "k", ["d", "id"], 2_000).collect()}
    assert many == want


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumns({"k": F.col("id") % 3, "d": F.col("id")})
    for out in (C.dedupe(df, "k", ["d"]), W.nth_dates(df, "k", "d", {"a": (0, 1), "b": (0, 2)})):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[-1]


def test_nth_dates_of_edge_groups(spark):
    df = spark.createDataFrame([("a", "in", 3), ("a", "in", 1), ("a", "in", None), ("a", "out", 9), ("b", "out", None), ("c", "else", 4)],
                               "k string, s string, d int")
    got = W.nth_dates(df, "k", "d", {"in_1": ("in", 1), "in_2": ("in", 2), "in_3": ("in", 3), "out_1": ("out", 1)}, status="s",
                      extra={"n_status": F.count_distinct("s")})
    assert rows(got) == [("a", 1, 3, None, 9, 2), ("b", None, None, None, None, 1), ("c", None, None, None, None, 1)]


def test_group_statistics_with_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 5), (2, None)], "k int, v int")
    assert rows(W.group_stats(df, "k", {"lo": F.min("v"), "n": F.count("*")})) == [(None, 1, 1, 2), (None, 5, 1, 2), (2, None, None, 1)]


@pytest.mark.parametrize("accuracy", [10_000, 50, 10])
def test_percentiles_of_groups_are_exact(spark, accuracy):
    """Groups of all sizes and with heavy ties, one of them hot, in and beyond the brackets of an approximate percentile."""
    rnd = random.Random(5)
    data = [(rnd.choice("aaaaab"), rnd.choice([81.0, 82.0, 82.5]) if rnd.random() < 0.5 else rnd.random() * 200) for _ in range(3_000)]
    data += [("c", 7.0)] * 500 + [("d", 1.0), (None, 3.0), (None, 4.0), ("e", None), ("e", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    percents, want = [0.5, 1, 25, 33, 50, 75, 99, 100], set()
    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g and v is not None and not math.isnan(v))
        for p in percents if values else ():
            at = len(values) * p / 100
            low = max(1, math.ceil(at - 1e-9))
            high = low + 1 if abs(at - round(at)) < 1e-9 and 1 <= round(at) < len(values) else low
            want.add((g, float(p), len(values), values[low - 1], values[high - 1]))
    assert {tuple(r) for r in O.group_percentiles(df, "g", "v", percents, accuracy).collect()} == want


def test_percentiles_of_large_whole_numbers(spark):
    base = 1 << 60
    df = spark.createDataFrame([(base + i,) for i in range(400)], "v bigint").withColumn("g", F.lit(0))
    for accuracy in (10_000, 20):
        got = {r["percent"]: (r["low"] - base, r["high"] - base) for r in O.group_percentiles(df, "g", "v", [1, 50, 99.9], accuracy).collect()}
        assert got == {1.0: (3, 4), 50.0: (199, 200), 99.9: (399, 399)}
    classes = [r["c"] for r in O.xtile(spark.createDataFrame([(base + i,) for i in range(5)], "v bigint"), "v", 2, "c").orderBy("v").collect()]
    assert classes == [1, 1, 1, 2, 2]


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert O.percentiles(df, "v", [50]) == {50: 1.5}
    assert sorted(str(r["c"]) for r in O.xtile(df, "v", 2, "c").collect()) == ["1", "2", "None", "None"]


def test_percentiles_average_the_middle(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert O.percentiles(df, "v", [25, 50, 60]) == {25: 1.5, 50: 2.5, 60: 3.0}
    assert O.percentiles(df.filter("v > 9"), "v", [50]) == {50: None}


def test_classes_by_value_and_by_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 2, 3, None])], "i int, v int")
    assert [r["c"] for r in O.xtile(df, "v", 2, "c").orderBy("i").collect()] == [1, 1, 1, 1, 2, None]
    assert [r["c"] for r in O.ntile_by(df, "v", 2, ["i"], "c").orderBy("i").collect()] == [1, 1, 1, 2, 2, None]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_numbering_does_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v")).repartition(partitions)
        assert rows(O.global_index(df, ["v"]).filter("v <> index")) == []
        total = O.running_total(df, ["v"], "v", "cum").filter("v = 499").first()["cum"]
        assert total == 499 * 500 // 2
        ids = P.group_id(df.withColumn("g", F.nullif(F.col("v") % 5, F.lit(3))), "g", "gid").select("g", "gid").distinct()
        assert rows(ids) == [(None, None), (0, 1), (1, 2), (2, 3), (4, 4)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_projections(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "t string, n int")
    coded, labels = P.encode(df, "t", "code")
    assert rows(labels) == [(1, "a"), (2, "b")] and rows(coded) == [(None, 3, None), ("a", 1, 1), ("b", 2, 2)]
    many, _ = P.encode(spark.range(1_500).select(F.format_string("%05d", "id").alias("t")), "t", "code")
    assert many.filter(F.col("code") != F.col("t").cast("int") + 1).count() == 0 and many.count() == 1_500
    with pytest.raises(ValueError):
        P.drop_cols(df, "nope")
    assert P.order_cols(df, ["n"]).columns == ["n", "t"] and P.cols(df, like="?") == ["t", "n"]
    expanded = P.expand_rows(spark.createDataFrame([(0,), (None,), (3,)], "n int"), "n")
    assert rows(expanded) == [(None, 1), (0, 1), (3, 1), (3, 2), (3, 3)]
    flags = P.code_flags(spark.createDataFrame([(10,), (12,), (None,)], "c int"), "c", {"x": [10, (12, 14)], "y": [10]})
    assert rows(flags) == [(None, 0, 0), (10, 1, 1), (12, 1, 0)]


def test_summaries(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in range(1, 11)], "v double, odd int")
    stats = {r["stat"]: r["value"] for r in C.summarize_detail(df, "v").collect()}
    assert stats["p50"] == 5.5 and stats["p25"] == 3.0 and stats["smallest_1"] == 1.0 and stats["largest_4"] == 7.0
    assert stats["skewness"] == pytest.approx(0) and stats["kurtosis"] == pytest.approx(1.7757575757)
    with_nan = df.unionByName(spark.createDataFrame([(float("nan"), 0), (None, 1)], "v double, odd int"))
    assert {r["stat"]: r["value"] for r in C.summarize_detail(with_nan, "v").collect()} == pytest.approx(stats)
    freq = C.freq_table(df, "odd").orderBy("odd").collect()
    assert [tuple(r) for r in freq] == [(0, 5, 50.0, 50.0), (1, 5, 50.0, 100.0)]
    steps = report.attrition({"all": df.withColumn("id", F.col("v") % 4), "odd": df.filter("odd = 1").withColumn("id", F.lit(None))}, "id")
    assert rows(steps) == [(1, "all", 10, 4), (2, "odd", 5, 1)]


def test_whole_numbers_keep_their_digits_in_summaries(spark):
    base = (1 << 53) + 1
    df = spark.createDataFrame([(base + i, i % 2) for i in range(8)], "v bigint, g int")
    exact = {r["stat"]: r["exact"] for r in C.summarize_detail(df, "v").collect()}
    assert (exact["smallest_1"], exact["largest_1"], exact["p1"], exact["mean"], exact["p50"]) == (base, base + 7, base, None, None)
    by_group = {(r["g"], r["stat"]): r["exact"] for r in C.summarize_groups(df, "g", "v").collect()}
    assert by_group[0, "smallest_2"] == base + 2 and by_group[1, "largest_4"] == base + 1
    nothing = {r["stat"]: r["value"] for r in C.summarize_detail(df.filter("v < 0"), "v").collect()}
    assert nothing == {}


def test_percentiles_run_nothing_before_they_are_used(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.raise_error(F.lit("read")).cast("double").alias("v"))
    lazy = C.summarize_groups(df, "g", "v"), O.xtile(df, "v", 3, "c")
    for out in lazy:
        with pytest.raises(Exception, match="read"):
            out.collect()


def test_attrition_counts_while_a_stage_is_stored(spark):
    steps = report.Attrition("id")
    df = spark.range(0, 100, 1, 4).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(3))))
    panel = steps.passed("panel", df, F.col("q") == 1)
    odd = steps.passed("odd", panel.filter("id % 2 = 1 AND q < 3"), F.col("q") == 1)
    people = steps.passed("people", odd.groupBy("id").count().join(spark.range(0, 100, 5), "id"))
    kept = stable(people)
    assert kept.count() == 10
    assert rows(steps.table(spark)) == [(1, "panel", 300, 100), (2, "odd", 100, 50), (3, "people", 10, 10)]
    assert rows(report.attrition({"panel": df, "people": kept}, "id")) == [(1, "panel", 300, 100), (2, "people", 10, 10)]


def test_cascade_is_disjoint_and_complete(spark):
    rnd = random.Random(11)

    def people(n, name):
        return spark.createDataFrame([(f"{name}{i}", rnd.choice([None, 1, 2, 3, 4, 5]), rnd.randint(1, 12)) for i in range(n)],
                                     f"{name} string, a int, b int")

    source, one, two = people(60, "s"), people(40, "p"), people(50, "p")
    linked, rest = L.link_cascade(source, [one, two], ["a", "b"])
    for out in (linked, rest):
        assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(a") == 1
    unique = {r["s"] for r in FL.keep_unique_keys(source, ["a", "b"]).collect()}
    found, left = [r["s"] for r in linked.collect()], [r["s"] for r in rest.collect()]
    assert len(found) == len(set(found)) and not set(found) & set(left) and set(found) | set(left) == unique
    assert {r["link_pass"] for r in linked.collect()} == {1, 2}
    decisions = spark.createDataFrame([(found[0], 1), (found[1], 0)], "s string, keep int")
    assert [r["s"] for r in L.apply_review(linked, decisions, "s").collect()] == [found[0]]
    assert L.apply_review(linked, decisions, "s", default_keep=True).count() == len(found) - 1


def test_matching_weights(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, int(rnd.random() < 0.3), rnd.randint(20, 90), rnd.choice("ab"), rnd.random()) for i in range(400)],
                               "id int, t int, age int, sex string, x double")
    out = matching.cem(df, "t", {"age": list(range(20, 100, 10))}, exact=["sex"], auto=["x"])
    sums = {(r["t"], r["cem_matched"]): (r["n"], r["w"]) for r in
            out.groupBy("t", "cem_matched").agg(F.count("*").alias("n"), F.sum("cem_weight").alias("w")).collect()}
    for arm in (0, 1):
        n, w = sums[(arm, 1)]
        assert w == pytest.approx(n) and sums.get((arm, 0), (0, 0))[1] == 0
    bins = [c for c in out.columns if c.startswith("bin_")]
    assert out.agg(F.max("bin_x"), F.min("bin_x")).first() == (math.ceil(math.log2(400) + 1) - 1, 0)
    after = matching.imbalance_l1(out.filter("cem_matched = 1"), "t", bins, "cem_weight").first()["l1"]
    before = matching.imbalance_l1(out, "t", bins).first()["l1"]
    assert after == pytest.approx(0, abs=1e-12) and before > 0.1
    edge = df.limit(1).select(matching.cut_bin(F.lit(30), [20, 30, 40]), matching.cut_bin(F.lit(29), [20, 30, 40])).first()
    assert tuple(edge) == (2, 1)  # bins are closed on the left


def test_attach_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    groups = spark.createDataFrame([(None, 10), (2, 20)], "k int, g int")
    assert rows(K.attach(df, groups, "k")) == [(None, "y", 10), (1, "x", None)]
    assert rows(K.attach(df, groups, "k", null_safe=False)) == [(None, "y", None), (1, "x", None)]
    assert K.literal_rows(spark, [], [("a", "int")]).dtypes == [("a", "int")]
