"""The three stages of the study on invented tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohort_engine.functions.dates import yq
from cohort_engine.operators.merge import is_unique
from cohort_engine.plans import study
from study_data import tables

PARAMS = study.StudyParams(site_aliases={"11B": "11"})


@pytest.fixture(scope="module")
def source(spark):
    return {k: v.persist() for k, v in tables(spark).items()}


@pytest.fixture(scope="module")
def sample_frames(source):
    return {k: v.persist() for k, v in study.sample_stage(source, PARAMS).items()}


@pytest.fixture(scope="module")
def panel(source, sample_frames):
    return study.panel_stage(source, sample_frames["sample"], PARAMS).persist()


def test_linkage(source, sample_frames):
    linked = sample_frames["linked"]
    assert is_unique(linked, "person_id")
    passes = {r["link_pass"]: r["count"] for r in linked.groupBy("link_pass").count().collect()}
    assert passes[1] > 20 and passes[2] > 5
    verdicts = {r["person_id"]: r["keep"] for r in source["decisions"].collect()}
    late = [(r["roster"], verdicts.get(r["person_id"])) for r in linked.filter("link_pass = 2").collect()]
    # one roster needs approval, the other only must not be refused
    assert all(keep == 1 for roster, keep in late if roster == "a") and all(keep != 0 for _, keep in late)
    assert sample_frames["review"].count() > len(late)
    # persons at an excluded site never enter a pool
    sites = {r[0] for r in linked.select("practice_id").distinct().collect()}
    assert "14" not in sites


def test_sample(sample_frames):
    sample = sample_frames["sample"]
    assert is_unique(sample, "person_id")
    assert sample.filter("treated = 1").count() > 20 and sample.filter("treated = 0").count() > 20
    assert sample.filter(F.col("post_code").isNull()).count() == 0
    early = F.datediff("withdrawn_1_a", "enrolled_1_a") <= 3
    assert sample.filter(early).count() == 0
    assert sample.filter("age < 18").count() == 0


def test_matched_is_part_of_sample(sample_frames):
    matched, sample = sample_frames["matched"], sample_frames["sample"]
    assert matched.join(sample, "person_id", "left_anti").count() == 0
    weights = matched.groupBy("treated").agg(F.sum("cem_weight").alias("w"), F.count("*").alias("n")).collect()
    for r in weights:
        assert abs(r["w"] - r["n"]) < 1e-9


def test_panel_is_complete(sample_frames, panel):
    persons = sample_frames["sample"].count()
    assert panel.count() == persons * 15
    assert is_unique(panel, ["person_id", "q"])
    assert panel.filter(F.col("pres_any").isNull() | F.col("service_gp_pooled").isNull()).count() == 0
    bounds = panel.agg(F.min("q"), F.max("q")).first()
    assert tuple(bounds) == (yq(2022, 1), yq(2025, 3))


def test_counts_against_plain_python(source, sample_frames, panel):
    people = {r[0]: r[1] for r in source["patient"].select("patientsitekey", "person_id").collect()}
    chosen = {r[0] for r in sample_frames["sample"].select("person_id").collect()}
    gp, total = 0, 0
    for name in ("service_older", "service"):
        for r in source[name].collect():
            if people[r["patientsitekey"]] not in chosen or r["service_item"] is None or r["service_date"] >= "2025-10-01":
                continue
            if any(c.isalpha() for c in r["service_item"]):
                continue
            gp += sum(1 for code in r["service_item"].split("/") if code in ("23", "36", "5028", "5043"))
    for r in source["prescription"].collect():
        if people[r["patientsitekey"]] in chosen and r["atc_code"] and r["prescription_date"] < "2025-10-01":
            total += r["atc_code"][0] in "ABCDGHJLMNPRSV"
    sums = panel.agg(F.sum("service_gp_pooled"), F.sum("pres_any")).first()
    assert tuple(sums) == (gp, total)


def test_analysis_and_model(panel):
    analysis = study.analysis_panel(panel, PARAMS).persist()
    assert {r[0] for r in analysis.select("sex").distinct().collect()} == {"Male", "Female"}
    assert analysis.filter("q >= q_dead").count() == 0
    # treatment switches on at event time -4 and stays on
    assert analysis.filter("(trel >= -4) <> (treat = 1)").count() == 0
    assert analysis.filter("first_enrol_q IS NULL AND treat = 1").count() == 0
    results = study.model_stage(analysis, PARAMS, ["gp_face_tele", "pres_any_LN"]).collect()
    specs = {(r["outcome"], r["spec"]) for r in results}
    assert len(specs) == 2 * len(study.model_specs())
    assert all(r["se"] > 0 for r in results if r["n_switchers"] > 5)
    assert study.graduates_only(analysis).count() < analysis.count()


def test_swapped_sample(panel, sample_frames):
    """The panel of some of the sample's persons keeps all their rows and no others."""
    some = sample_frames["sample"].filter("treated = 1")
    swapped = study.swap_sample(panel, some)
    assert sorted(swapped.columns) == sorted(panel.columns)
    expected = panel.join(some.select("person_id"), "person_id", "left_semi")
    assert swapped.count() == expected.count() > 0
    assert swapped.select("person_id").distinct().count() == some.count()
