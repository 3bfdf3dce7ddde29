"""Every text operator and stage on small frames: nulls, empty and long texts, ties, repeated rows,
empty tables, and columns whose names clash with inner ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_engine.llm import language, lines, mixing, pii, quality, simhash, substrings, tiling, tokens, warc
from cohort_engine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, doc string, words string, fp long"
PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (3, PASSAGE + " end", "en", None), (4, None, None, "b"), (5, "", "en", "b"),
            (6, " \n\t ", "fr", "b"), (7, "One", "fr", "c"), (None, PASSAGE, None, "c"), (None, None, None, None),
            (8, "a\nb\nc\nd", "en", "a"), (8, "a\nb\nc\nd", "en", "a"), (9, "a b " * 30_000, "en", "a"),
            (10, "Mail bo@ex.org or +1 (212) 555-0142, ip 10.0.0.1, card 4111 1111 1111 1111. \U0001F642", "en", "c"),
            (11, "12345 !!! ...", "en", "c"), (12, "x" * 300_000, "en", "b"), (12, "other", "en", "b")]
    return spark.createDataFrame([(*r, 7, "k", "d", "w", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"Word{i}," for i in range(20, 40))), (2, "too short"), (None, "a b a b a b a b"), (3, None)],
                                 "item_id long, text string")


def by_id(df, *cols):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in cols)) for r in df.collect()), key=str)


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    zero = "0" * 16
    assert [g for g in got if g[0] in (4, 5, 6)] == [(4, zero, 4), (5, zero, 4), (6, zero, 4)]
    assert {g[2] for g in got if g[0] in (1, 2)} == {1} and (-1, zero, 4) in got and len(got) == 16
    first = simhash.first_of_each(docs)
    assert first.columns == docs.columns
    kept = sorted(r["doc_id"] for r in first.collect())
    assert kept.count(8) == 1 and 2 not in kept and 5 not in kept and None not in kept


def test_language(docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (11, "und"), (None, "und")} <= got and len(got) == 14


def test_language_ties(spark):
    """Of languages that nothing tells apart the first in order is taken, and the text is ambiguous."""
    rows = spark.createDataFrame([(i, "the same words", lang) for i, lang in enumerate(["b", "a", "c", "a", "b", "c"])], "doc_id long, text string, lang string")
    got = language.predict(rows, language.train(rows, rounds=0)).collect()  # nothing learned
    assert {(r["lang_pred"], r["ambiguous"]) for r in got} == {("a", True)} and got[0]["score"] == pytest.approx(1 / 3)


def test_language_without_labels(docs):
    got = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in got} == {("und", 0.0, False)}


def test_contamination(docs, benchmark):
    got = by_id(tiling.contamination(docs, benchmark), "item_id", "coverage", "n_tiles", "contaminated")
    assert (1, 1, 1.0, 1, True) in got and (4, None, 0.0, 0, False) in got and (9, None, 1.0, 1, True) in got
    kept = tiling.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 16 - 5
    assert tiling.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_personal_data(docs):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[10]["base"] == "email:5:14,phone:18:35,ip:40:48,card:55:74"
    assert got[10]["base"] in got[10]["spans"] or set(got[10]["base"].split(",")) <= set(got[10]["spans"].split(","))
    assert got[4]["spans"] == "" and got[12]["n_email"] == 0
    rows = pii.find(docs).collect()
    assert len(rows) == 16 and [r["base"] for r in rows if r["doc_id"] is None] == ["", ""]


def test_quality(docs):
    got = by_id(quality.assess(docs), "n_words", "n_repeat_words", "base_failed", "kept")
    assert (1, 60, 0, False, True) in got and (4, 0, 0, True, False) in got and (9, 60_000, 60_000, True, False) in got
    assert (8, 4, 0, True, False) in got
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]


def test_substrings(docs):
    got = by_id(substrings.deduplicate(docs), "n_words", "n_removed", "kept")
    assert (1, 60, 60, "") in got and (3, 61, 60, "end") in got and (9, 60_000, 60_000, "") in got
    assert (4, 0, 0, "") in got and (7, 1, 0, "One") in got


def test_lines(docs):
    got = by_id(lines.deduplicate(docs), "n_lines", "n_removed", "kept")
    assert got.count((8, 4, 0, "a\nb\nc\nd")) == 2 and (6, 0, 0, " \n\t ") in got and (4, 0, 0, "") in got


def test_mixing(docs):
    rows = mixing.shares(docs).collect()
    assert len(rows) == 16 and all(r["taken"] <= 3 * r["size"] for r in rows)
    per = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in per.values()) == pytest.approx(sum(s for _, s in per.values()))
    assert sum(r["taken"] for r in rows) == sum(r["size"] for r in rows)  # the whole budget
    for source, (target, _) in per.items():  # a budget of whole words may leave a word a source over
        assert 0 <= sum(r["taken"] for r in rows if r["source"] == source) - int(target) <= len(per)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count("text"))).first()[0] == sum(r["taken"] for r in rows)


def test_tokens(docs):
    got = [tuple(r) for r in tokens.round_trip(docs, tokenizer_path()).orderBy("start").collect()]
    ids = [g[0] for g in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None, None]
    assert [g[1] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert [g[2] for g in got if g[0] in (4, 5, 6)] == [1, 1, 1]


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://x/1", "body"), (1, None, "body"), (2, "http://x/ a\r\nb", None), (None, "u", "body"), (4, "u", ""),
                                   (5, "u", "é" * 700_000), (1, None, "body")], "page_id long, url string, html string").withColumn("record", F.lit("x"))
    got = {tuple(r) for r in warc.round_trip(pages).collect()}
    by = {(g[0], g[3], g[4]) for g in got}
    assert by == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None)}
    assert {g[1] for g in got if g[0] == 5} == {1_400_000}
    assert {g[3] for g in {tuple(r) for r in warc.round_trip(pages, min_bytes=5).collect()}} == {"response"}


def test_empty_tables(spark, docs, benchmark):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).count() == 0
    assert language.identify(none).count() == 0 and pii.find(none).count() == 0
    assert tiling.contamination(none, benchmark).count() == 0 and quality.assess(none).count() == 0
    assert substrings.deduplicate(none).count() == 0 and lines.deduplicate(none).count() == 0
    assert mixing.shares(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert tokens.round_trip(none, tokenizer_path()).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {name: sorted(str(r["doc_id"]) for r in stage(spark, docs, str(tmp_path)).collect()) for name, stage in corpus_pipeline.STAGES[:3]}
    assert ids["quality rules"] == ["1", "2", "3", "None"]
    assert ids["simhash near-dedup"] == sorted(str(r["doc_id"]) for r in simhash.first_of_each(docs).collect())
    assert ids["simhash near-dedup"].count("8") == 1 and "2" not in ids["simhash near-dedup"]
    assert ids["benchmark decontamination"] == sorted(["4", "5", "6", "7", "8", "8", "10", "11", "12", "12", "None"])
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert name == "token files" or out.columns == docs.columns
            assert (out.count() > 0) == (given is docs)


def test_a_run_can_be_closed(spark, docs):
    from cohort_engine.llm import common
    assert common.stored(docs, "kept").count() == 16
    system, folder = common.opened(common.run_folder(spark))
    assert system.get_file_info(folder).type.name == "Directory"
    common.close_run(spark)
    assert system.get_file_info(folder).type.name == "NotFound"
    common.close_run(spark)  # again, with nothing left


def test_substring_lookups_leave_no_shuffle_files(spark, docs):
    """The lookups of operator 6 are stored; what they shuffled goes with their jobs, whenever garbage is collected."""
    import time
    from pathlib import Path

    from cohort_engine.llm import common
    top = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())

    def files():
        return {f.name for f in top.rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(common.SHUFFLE_CLEANUP)
    out = substrings.deduplicate(docs)  # its last join is not run yet
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    for _ in range(2):  # what is left reads stored rows, so it can run again
        assert {r["n_removed"] for r in out.filter("doc_id IN (1, 2, 3)").collect()} == {60}
