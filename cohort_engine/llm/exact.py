"""Exact duplicates by heavy-hitter split, in built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, key_id, key_text, stored

COUNTERS = 1 << 16  # counters of a summary: a digest's count is off by at most 3.5 / COUNTERS of the rows
HEAVY = 1 << 13  # digests that the summary names at most
MERGERS = 64  # tasks that merge the summaries of map tasks before the last one does


def normalised(text: Column) -> Column:
    """Lower case for A to Z alone; null is empty. `lower` may do it where all is ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`k_id`, `k_text`, `doc_id`, `digest` (32 bytes), `row` (no two rows share one) of every row.

    Stored, so that texts are read once and a row keeps its number.
    """
    rows = docs.select(key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text"), F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return stored(rows, "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """`item` (a 64-bit hash of a digest), at most HEAVY rows, among them every digest that more
    than one in HEAVY / 2 of all rows has.

    A Misra-Gries summary (Spark's frequent-items sketch) of COUNTERS counters is built in
    each map task, merged in MERGERS tasks and at last in one; its size does not grow with the
    input. An estimate is never below the count and at most 3.5 / COUNTERS of the rows above it, so fewer
    than HEAVY digests can reach the estimate of one that common.
    """
    item = rows.select(F.xxhash64("digest").alias("item"), (F.spark_partition_id() % MERGERS).alias("merger"))
    parts = item.groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(item, {COUNTERS})").alias("s"))
    whole = parts.groupBy(F.lit("all")).agg(F.expr("approx_top_k_combine(s)").alias("s"))  # no row for an empty table
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {HEAVY})")).alias("t")).select(F.col("t.item").alias("item"))


def groups(rows: DataFrame) -> DataFrame:
    """`rows` with `keep` (struct of `doc_id`, `turn`: the row that stays) and `size` of the row's group.

    Copies of frequent digests are counted in an aggregate over the rows that the summary
    names, and those with a second row are the verified winners. They are broadcast (HEAVY rows
    at most) and their rows are dealt with where they lie; only the others are shuffled by digest.
    """
    keep = F.max(F.struct("doc_id", (-F.col("row")).alias("turn"))).alias("keep")
    size = F.count(F.lit(1)).alias("size")
    named = rows.join(F.broadcast(frequent(rows)), F.xxhash64("digest") == F.col("item"), "left_semi")
    winners = stored(named.groupBy("digest").agg(keep, size).filter("size > 1"), "winners")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    found = light.groupBy("digest").agg(keep, size)
    return (rows.join(F.broadcast(winners), "digest")
            .unionByName(light.join(found.withColumnRenamed("digest", "d"), F.col("digest").eqNullSafe(F.col("d"))).drop("d")))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`k_id`, `k_text`, `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256` for every row of `docs`.

    Texts are equal if they are identical after lower-casing A to Z; null counts as empty, and
    empty texts are equal to each other. Of equal texts the row of the largest id stays: a null
    id only if all its group's are null, and of rows that share that id the first stored, so
    that one row of each group is kept. Whole texts are compared by their SHA-256, whatever
    their length. Other columns are not read. An empty table gives no rows.
    """
    rows = groups(digests(docs, id_col, text_col))
    stays = F.col("keep").eqNullSafe(F.struct("doc_id", (-F.col("row")).alias("turn")))
    return rows.select("k_id", "k_text", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
                       stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that stay; of rows equal in id and text, one."""
    stay = duplicates(docs, id_col, text_col).filter("kept").select("k_id", "k_text")
    copies = docs.select(key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text")).groupBy("k_id", "k_text").agg(
        F.count(F.lit(1)).alias("n_rows"))
    return attach(docs, id_col, text_col, stay.join(copies, ["k_id", "k_text"])).select("doc.*")
