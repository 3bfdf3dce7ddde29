"""A key that holds a third of all rows: results stay whole, and the hot group is reduced
on the map side or split between tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohort_engine.operators import collapse as C, filters as FL, merge as M, windows as W
from cohort_engine.plans import events as E

N = 120_000


@pytest.fixture()
def skewed(spark):
    """Rows with a hot key, and a session where joins must shuffle and count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    yield spark.range(0, N, 1, 16).select("id", key.alias("k"), (F.col("id") % 997).alias("d"), F.hash("id").alias("pad"))
    for key in settings:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plan_after(df) -> tuple[list, str]:
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_statistics_on_rows_split_the_hot_key(skewed):
    out = W.group_stats(skewed, "k", {"n": F.count("*"), "hi": F.max("d")}, null_safe=False)
    rows, plan = plan_after(out)
    assert "skewed" in plan or "skew=true" in plan
    assert len(rows) == N
    assert {r["n"] for r in rows if r["k"] == -1} == {N // 3}


@pytest.mark.parametrize("kind", ["m:1", "1:m"])
def test_merge_splits_the_hot_key_of_the_many_side(skewed, spark, kind):
    people = spark.range(-3, 4000).select(F.col("id").alias("k"), F.lit(1).alias("p"))
    sides = (skewed, people) if kind == "m:1" else (people, skewed)
    rows, plan = plan_after(M.merge_tables(*sides, "k", kind, null_safe=False))
    assert "skewed" in plan or "skew=true" in plan
    many, one = (1, 2) if kind == "m:1" else (2, 1)
    counts = {s: sum(r["_merge"] == s for r in rows) for s in (1, 2, 3)}
    expected = skewed.filter("k >= 4000").count()
    assert counts[many] == expected and counts[3] == N - expected
    used = {r["k"] for r in rows if r["_merge"] == 3}
    assert counts[one] == 4003 - len(used)


def test_hot_groups_in_reductions(skewed):
    assert FL.keep_unique_keys(skewed, ["k"]).filter("k = -1").count() == 0
    first = C.dedupe(skewed, "k", ["d", "id"]).filter("k = -1").first()
    assert (first["id"], first["d"]) == (0, 0)
    top = W.first_k(skewed, "k", ["d", "id"], 5).filter("k = -1").orderBy("seq").collect()
    assert [r["id"] for r in top] == [0, 2991, 5982, 8973, 11964]
    kept = FL.keep_groups_any(skewed, "k", F.col("id") == 0, null_safe=False)
    assert kept.count() == N // 3


def test_sequence_of_a_hot_group_uses_many_tasks(skewed):
    out = W.seq_in_group(skewed, "k", ["d", "id"])
    hot = out.filter("k = -1")
    assert hot.agg(F.count("*"), F.min("seq"), F.max("seq"), F.count_distinct("seq")).first() == (N // 3, 1, N // 3, N // 3)
    assert out.filter("k <> -1").agg(F.max("seq")).first()[0] <= 16


def test_event_counts_of_a_hot_person(skewed):
    events = skewed.select(F.col("k").alias("person"), F.lit(1).alias("q"), (F.col("id") % 50).alias("practice"),
                           F.nullif(F.col("d") % 7, F.lit(3)).alias("provider"), (F.col("d") % 10).cast("int").alias("code"))
    row = E.event_counts(events, ["person", "q"], "code", {"low": [(0, 4)], "one": [1]},
                         {"prac": "practice", "prov": "provider"}).filter("person = -1").first()
    hot = [i for i in range(N) if i % 3 == 0]
    assert row["low"] == sum((i % 997) % 10 <= 4 for i in hot) and row["one"] == sum((i % 997) % 10 == 1 for i in hot)
    assert (row["prac"], row["prov"]) == (50, 7)


def test_grouped_lookup_moves_neither_side_again(skewed, spark):
    """Rows just grouped by the key meet a table whose key is checked: one exchange each, for the group and for the check."""
    known = spark.range(6000).select(F.nullif("id", F.lit(7)).alias("k"), (F.col("id") * 2).alias("p"))
    table = known.unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k long, p long"))
    groups = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).unionByName(spark.createDataFrame([(None, 5)], "k long, n long"))
    groups = groups.groupBy("k").agg(F.sum("n").alias("n"))
    out = M.map_to_person(groups, table, "k", "p", grouped=True)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, M.map_to_person(groups, table, "k", "p").collect()))
    _, plan = plan_after(M.map_to_person(skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")), known, "k", "p", grouped=True))
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    with pytest.raises(Exception, match="is not unique"):
        M.map_to_person(groups, known.unionByName(known.filter("k = 9")), "k", "p", grouped=True).collect()
