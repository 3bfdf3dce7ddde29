"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordering import running_total, running_totals
from .common import attach, checkpoint, key_id, key_text

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
LIMIT = 3  # times that a document may be taken at most
BUCKET_ROWS = 50_000  # documents of a source whose order one task works out, about
FEWEST_DIGITS = 2  # so that even in small tables no task holds a whole source


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """`row` (its number), `k_id`, `k_text`, `doc_id`, `source`, `size`, `u` per row: u is its place in
    the shuffle, a hash of the seed and the id, so that reruns agree."""
    return checkpoint(docs.select(
        F.monotonically_increasing_id().alias("row"),
        key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("u")))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`source`, `source_size`, `target` per source.

    Sources in order of code points (null last) have the weights in turn. All shares add up
    to the size of all sources; a share above LIMIT times its source stops there and the rest
    is shared again: the common level is the first, in order of limit per weight, that lies
    within the next source's limit. Ranks and sums over sources are running totals over slices, so there may be
    as many sources as web domains.
    """
    per = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running_total(per.withColumn("one", F.lit(1)), "source", "one", "rank")
    cycle = F.array(*map(F.lit, weights))
    per = ranked.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights))).withColumn("most", LIMIT * F.col("source_size"))
    per = checkpoint(per.withColumn("ratio", F.col("most").cast("double") / F.col("weight")))
    filled = running_totals(per, ["ratio", "source"], {"most_upto": "most", "weight_upto": "weight"})
    whole = per.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    left = F.lit(whole["s"]) - (F.col("most_upto") - F.col("most"))
    level = left.cast("double") / (F.lit(whole["w"]) - (F.col("weight_upto") - F.col("weight")))
    fits = filled.withColumn("level", level).filter("level <= ratio")
    first = fits.agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("level")).first()["level"]
    return per.select("source", F.col("source_size").cast("long").alias("source_size"),
                      F.least(F.col("most").cast("double"), F.lit(first).cast("double") * F.col("weight")).alias("target"))


def queued(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """`rows` with their source's `source_size`, `target` and with `before`, the words of the
    source that are ahead in its shuffled order.

    The order is cut into buckets by the first digits of `u`. Sums of buckets are added up per
    source, sums of rows within a bucket, so no task holds a whole source.
    """
    n = rows.count()
    digits = max(FEWEST_DIGITS, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    rows = rows.withColumn("bucket", F.substring("u", 1, digits))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))))
    known = buckets.join(targets(rows, weights).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    within = W.partitionBy("source", "bucket").orderBy("u", "k_id", "k_text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("before", F.col("ahead") + F.col("inner")).drop("s", "b", "ahead", "inner", "bucket"))


def packets(rows: DataFrame) -> DataFrame:
    """The `queued` rows in up to LIMIT passes, each as a packet, with `copy` (its pass), `words` and `finish`.

    A packet's virtual finish time is the words of its source up to its end, over the source's
    target. The copy that a source has under way at time 1, where its target lies, is two packets, cut there.
    """
    start = F.col("before") + F.col("copy") * F.col("source_size")
    cut = F.greatest(start, F.least(start + F.col("size"), F.floor("target")))
    parts = F.array(F.when((cut > start) | (F.col("size") == 0), F.struct(start.alias("a"), cut.alias("b"))),
                    F.when(cut < start + F.col("size"), F.struct(cut.alias("a"), (start + F.col("size")).alias("b"))))
    each = rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(LIMIT))))).withColumn("p", F.explode(F.array_compact(parts)))
    finish = F.when(F.col("target") > 0, F.col("p.b") / F.col("target")).otherwise(0.0)
    return each.withColumns({"words": F.col("p.b") - F.col("p.a"), "finish": finish}).drop("p", "before")


def stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The packets in the order of the mix, with `offset` (words ahead) and `taken` (words before the budget is spent).

    Packets of all sources are range-sorted by virtual finish time over all tasks; `offset`
    comes from one sum per task and sums within it. The mix ends where the total budget, the size of all
    sources, does: there the last packet is taken in part and later ones not at all. As
    targets add up to the budget, that is at time 1, but for the parts of words that targets may have.
    """
    rows = sized(docs, id_col, text_col, source_col, seed)
    budget = rows.agg(F.sum("size")).first()[0] or 0
    order = ["finish", "u", "k_id", "k_text", "row", "copy"]
    ordered = checkpoint(packets(queued(rows, weights)).orderBy(*order).withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.sum("words").alias("w"))
    ahead = sums.select("part", F.coalesce(F.sum("w").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0))
    return (ordered.join(ahead, "part").withColumn("offset", offset).drop("ahead", "part")
            .withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("offset"))).cast("long")))


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """`k_id`, `k_text`, `doc_id`, `source`, `size`, `source_size`, `target`, `taken` per row of `docs`.

    `taken` is what `stream` takes of the row, in all its passes. Null texts have no words;
    sources of no words get nothing; equal rows are shuffled next to each other. An empty table gives no rows.
    """
    found = stream(docs, id_col, text_col, source_col, weights, seed)
    same = [F.first(c).alias(c) for c in ("k_id", "k_text", "doc_id", "source", "size", "source_size", "target")]
    return found.groupBy("row").agg(*same, F.sum("taken").cast("long").alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    n_chars_col: str = "n_chars", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", whole: bool = False) -> DataFrame:
    """The mix as rows of `docs`, with their columns: a row for each copy taken.

    A copy of which the mix takes a part keeps its first words (joined by one space), and
    `n_chars_col`, if there is such a column, follows. With `whole` no text is cut: a copy of which
    the mix takes a part is taken whole if that is at least half of its words, else left
    out. Texts without a word are not taken; repeated rows are copies of their own.
    """
    found = stream(docs, id_col, text_col, source_col, weights, seed).filter("taken > 0")
    per = (found.groupBy("k_id", "k_text", "row", "copy").agg(F.sum("taken").alias("words"))
           .groupBy("k_id", "k_text").agg(F.collect_list("words").alias("turns")))
    rows = docs.select(key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text")).groupBy("k_id", "k_text").agg(
        F.count(F.lit(1)).alias("n_rows"))
    copies = attach(docs, id_col, text_col, per.join(rows, ["k_id", "k_text"])).select("doc", F.explode("turns").alias("words"))
    if whole:
        size = word_count("text_whole")
        return (copies.withColumn("text_whole", F.col("doc").getField(text_col)).filter(2 * F.col("words") >= size).select("doc.*"))
    words = F.array_remove(F.split(F.col("doc").getField(text_col), SPACE), "")
    text = F.when(F.size(words) > F.col("words"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(
        F.col("doc").getField(text_col))
    out = []
    for field in docs.schema.fields:
        value = F.col("doc").getField(field.name)
        if field.name == text_col:
            value = F.col("text_taken")
        elif field.name == n_chars_col:
            value = F.when(F.col("text_taken").eqNullSafe(F.col("doc").getField(text_col)), value).otherwise(
                F.length("text_taken")).cast(field.dataType)
        out.append(value.alias(field.name))
    return copies.select("doc", text.alias("text_taken")).select(*out)
