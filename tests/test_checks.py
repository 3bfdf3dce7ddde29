"""What the pipelines rely on is checked: unique keys, readable link keys, one row per person."""

from __future__ import annotations

import pytest

from cohort_engine.operators import merge as M
from cohort_engine.plans import linking, panel as PN, sample as SP
from conftest import rows

KEYS = ["post_code", "yob"]


def test_repeated_keys_fail_by_default(spark):
    many = spark.createDataFrame([("1-1", 5), ("1-1", 6)], "site_key string, n int")
    patient = spark.createDataFrame([("1-1", "p"), ("1-1", "q")], "site_key string, person string")
    with pytest.raises(Exception, match="not unique"):
        M.map_to_person(many, patient, "site_key", "person").collect()
    with pytest.raises(Exception, match="not unique"):
        M.merge_tables(many, patient.limit(1), "site_key", "1:1").collect()
    assert M.map_to_person(many, patient.limit(1), "site_key", "person").count() == 2


def test_keys_that_match_nothing_may_repeat(spark):
    table = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    got = M.lookup(spark.createDataFrame([(3,), (None,)], "k int"), table, "k", required=False)
    assert rows(got) == [(None, None), (3, 3)]
    with pytest.raises(Exception, match="not unique"):
        M.lookup(table.select("k"), table, "k", null_safe=True).collect()


def test_panel_and_conditions_check_their_persons(spark):
    sample = spark.createDataFrame([("p", 1), ("p", 2)], "person string, n int")
    counts = spark.createDataFrame([("p", 1, 4)], "person string, q int, c int")
    with pytest.raises(Exception, match="not unique"):
        PN.build_panel(sample, 1, 2, [(counts, ["c"])], "person").collect()
    linked = spark.createDataFrame([("p", 1), ("p", 0)], "person string, cardio_a int")
    profile = spark.createDataFrame([("p", 1)], "person string, has_cardio int")
    with pytest.raises(Exception, match="not unique"):
        SP.reconcile_conditions(linked, profile, "person", {"cardio": ("has_cardio", ["cardio_a"])}).collect()


def test_unfilled_facts_stay_missing(spark):
    sample = spark.createDataFrame([("p",)], "person string")
    counts = spark.createDataFrame([("p", 1, 4, 2)], "person string, q int, c int, sites int")
    got = PN.build_panel(sample, 1, 2, [(counts, ["c", "sites"])], "person", fill=["c"])
    assert rows(got.select("q", "c", "sites")) == [(1, 4, 2), (2, 0, None)]


def test_unreadable_keys_link_to_nothing(spark):
    roster = spark.createDataFrame([("r1", None, 1950), ("r2", "3001", 1960)], "key string, post_code string, yob int")
    pool = spark.createDataFrame([("p1", "Unknown", 1950), ("p2", "3001 ", 1960)], "person_id string, post_code string, yob int")
    linked, _ = linking.link_rosters({"a": roster}, [pool], KEYS)
    assert [(r["key"], r["person_id"]) for r in linked.collect()] == [("r2", "p2")]
    missing = spark.createDataFrame([("p1", "", 1950)], "person_id string, post_code string, yob int")
    linked, _ = linking.link_rosters({"a": roster}, [missing], KEYS)
    assert [(r["key"], r["person_id"]) for r in linked.collect()] == [("r1", "p1")]


def test_a_person_of_two_rosters_is_one_row(spark):
    linked = spark.createDataFrame([("p", 1, "a", 1, None, "x"), ("p", 1, "b", None, 0, "y"), ("q", 1, "b", None, 1, "z")],
                                   "person string, link_pass int, roster string, cardio_a int, cardio_b int, note string")
    got = linking.one_row_each(linked, "person", ["link_pass", "roster"])
    assert rows(got.select("person", "cardio_a", "cardio_b", "note", "roster")) == [("p", 1, 0, "x", "a"), ("q", None, 1, "z", "b")]
    profile = spark.createDataFrame([("p", 0)], "person string, has_cardio int")
    out = SP.reconcile_conditions(got, profile, "person", {"cardio": ("has_cardio", ["cardio_a", "cardio_b"])})
    assert rows(out.select("person", "cardio", "no_cond")) == [("p", 1, 0), ("q", 1, 0)]
