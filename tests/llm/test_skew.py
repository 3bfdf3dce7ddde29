"""A key that holds a third of all rows: the joins back to it are split between tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohort_engine.llm import components, lines, simhash, substrings, warc

N = 60_000
HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def hot(spark):
    """A session where joins must shuffle and count as skewed."""
    for key, value in HOT.items():
        spark.conf.set(key, value)
    yield spark
    for key in HOT:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def split_rows(df) -> list:
    rows = df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    return rows


def test_star_of_a_hub(hot):
    links = hot.range(1, N, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {r["b"] for r in split_rows(components._star(links, large=True)) if r["a"] % 3 == 0} == {0}


def test_common_window_of_lines(hot):
    text = F.when(F.col("id") % 3 == 0, "x\ny\nz").otherwise(F.concat_ws("\n", F.lit("a"), (F.col("id") % 20_000).cast("string"), F.lit("b")))
    rows = split_rows(lines.later_windows(hot.range(0, N, 1, 8).select(F.col("id").alias("k_id"), F.lit(0).cast("long").alias("k_text"),
                                                                      F.col("id").alias("doc_id"), text.alias("text")), 3))
    assert len(rows) == N - 1 - len({i % 20_000 for i in range(N) if i % 3})


def test_common_seed_of_phrases(hot):
    """One seed with very many contexts: windows of 4 words around it, none repeated but one."""
    text = F.concat_ws(" ", F.lit("s"), F.when(F.col("id") < 2, F.lit("x")).otherwise(F.col("id").cast("string")), F.lit("t"), F.lit("u"))
    docs = hot.range(0, N, 1, 8).select(F.col("id").alias("k_id"), F.lit(0).cast("long").alias("k_text"), F.col("id").alias("doc_id"), text.alias("text"))
    assert sorted(r["k_id"] for r in substrings.repeated_spans(docs, 4).collect()) == [0, 1]
    entry = hot.range(0, N, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_000).alias("seed"), "id")
    differs = entry.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    assert len(split_rows(substrings.members(entry, differs, "seed", null_safe=False))) > N // 3


def test_common_payload(hot):
    pages = hot.range(0, N, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                         F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20_000).cast("string")).alias("html"))
    rows = split_rows(warc.kinds(warc.chunks(pages)))
    assert sum(r["refers_to"] == 0 for r in rows) == N // 3 - 1


def test_component_of_a_third_of_the_rows(hot):
    docs = hot.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(
        F.concat_ws(" ", *(F.xxhash64(F.lit(j), "id").cast("string") for j in range(4)))).alias("text"))
    rows = split_rows(simhash.near_duplicates(docs))
    assert {r["component_id"] for r in rows if r["doc_id"] % 3 == 0} == {0} and len(rows) == 20_000
