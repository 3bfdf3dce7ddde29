"""A Merkle manifest of a dataset: a hash tree per key, a tree over their roots, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ship, stored

LEVELS = 10  # levels of a superblock, which so has 1,024 nodes of the level below it
STEP = 33  # bytes of a step of a proof: the side of the sibling and its digest
LEFT, RIGHT, ALONE = b"L", b"R", b"-" + bytes(32)  # sides; a node that is hashed alone has no sibling


def hashed(nodes: Sequence[bytes]) -> bytes:
    """SHA-256 of digests as lower-case hex text, one after the other."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def levels_of(nodes: list[bytes], n: int, levels: int) -> list[list[bytes]]:
    """All levels of a superblock, from its nodes to its top, in a tree with `n` nodes of its lowest level.

    If it holds them all, the top is the first level of one node. Else it is `levels` levels
    up: a superblock of one node beside others is hashed alone that often.
    """
    out = [nodes]
    while len(out[-1]) > 1 or n > 1 << levels and len(out) <= levels:
        out.append([hashed(out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(levels: list[list[bytes]], i: int) -> bytes:
    """The steps from node `i` of a superblock to its top, STEP bytes each."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((LEFT if j < i else RIGHT) + level[j] if j < len(level) else ALONE)
        i >>= 1
    return b"".join(out)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the steps of its proof lead to."""
    for i in range(0, len(path), STEP):
        side, other = path[i:i + 1], path[i + 1:i + STEP]
        digest = hashed([digest] if side == ALONE[:1] else [other, digest] if side == LEFT else [digest, other])
    return digest


def siblings(path: Column) -> Column:
    """The siblings of a proof as hex text, from leaf to root, in an array."""
    places = F.when(F.length(path) > 0, F.sequence(F.lit(1), F.length(path).cast("int"), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda at: F.hex(F.substring(path, at, F.lit(1))) != ALONE[:1].hex().upper())
    return F.transform(found, lambda at: F.lower(F.hex(F.substring(path, at + 1, F.lit(32)))))


def leaf(values: Sequence[Column]) -> Column:
    """Digest (32 bytes) of a row: of each value the number of bytes, a colon and the value; `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", key_col: str = "lang",
           changed: Mapping[str, Column] | None = None) -> DataFrame:
    """`tree`, `key`, `idx` (place in the tree), `n` (leaves of the tree), `doc_id`, `leaf`, `claim` per row.

    Leaves are range-sorted by key (null first) and id over all tasks and stored, so a hot key spans many
    tasks and no place comes from a window over it: a row's place is its position in its
    task plus the number of rows of its key in earlier tasks. A tree is named by the position of its
    first row, so names are in the order of keys. `claim` is the digest of a copy of the row in
    which the columns of `changed` have other values, or null where it is the same.
    """
    changed = changed or {}
    same, other = leaf([F.col(c) for c in columns]), leaf([changed.get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("doc_id"), same.alias("leaf"),
                       (other if changed else same).alias("claim")).withColumn("claim", F.nullif("claim", "leaf"))
    order = ["key", "doc_id", "leaf", "claim"]
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "leaves")
    ahead = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    slices = (rows.groupBy("key", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
              .withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0))))
    trees = slices.groupBy("key").agg(F.min("first").alias("tree"), F.sum("rows").alias("n"))
    slices = slices.join(trees.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select(
        F.col("part").alias("p"), F.col("key").alias("k"), "first", "ahead", "tree", "n")
    return rows.join(slices, (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).select(
        "tree", "key", (F.col("ahead") + F.col("row") - F.col("first")).alias("idx"), "n", "doc_id", "leaf", "claim")


def blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", levels))


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes above the superblocks of `nodes` (`tree`, `idx`, `n`, `digest`), in the same form."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        first = rows.iloc[0]
        top = levels_of([bytes(x) for x in rows["digest"]], int(first["n"]), levels)[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "idx": [first["block"]], "n": [-(-int(first["n"]) >> levels)], "digest": [top]})

    ship(nodes.sparkSession)
    return stored(blocked(nodes.select("tree", "idx", "n", "digest"), levels).groupBy("tree", "block").applyInPandas(
        reduce, "tree long, idx long, n long, digest binary"), "nodes")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """`nodes` and the tops above them, round after round, until each tree has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(tops(out[-1], levels))
    return out


def paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """`tree`, `idx`, `path`, `subroot`, `root` of `nodes`, from those of the superblocks above (`outer`)."""
    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("idx"), above.iloc[0]
        tree = levels_of([bytes(x) for x in rows["digest"]], int(rows["n"].iloc[0]), levels)
        found = [steps(tree, i) + bytes(above["path"]) for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "path": found, "subroot": above["subroot"], "root": above["root"]})

    return stored(blocked(nodes, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "idx")).applyInPandas(
        join, "tree long, idx long, path binary, subroot binary, root binary"), "paths")


def numbered(nodes: DataFrame) -> DataFrame:
    """The tops of the trees as nodes of one tree over them: `tree` 0, `idx` in the order of keys."""
    rows = stored(nodes.repartitionByRange("tree").sortWithinPartitions("tree").select(
        F.col("tree").alias("key_tree"), "digest", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part")), "roots")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per task
    slices = (rows.groupBy("part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
              .select("part", "first", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"), F.sum("rows").over(W.partitionBy()).alias("n")))
    return rows.join(slices, "part").select(
        F.lit(0).cast("long").alias("tree"), (F.col("ahead") + F.col("row") - F.col("first")).alias("idx"), "n", "digest", "key_tree")


def proven(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`key`, `doc_id`, `leaf`, `subroot`, `root`, `path`, `folded` for the rows of `leaves`.

    Superblocks are reduced to their tops, round after round, each round in tasks of one superblock.
    On the way down, nodes are cogrouped with the outer nodes that their superblock needs (its path
    to the root): one step for every round, and at the leaves it finishes the local reduction, puts the proofs together
    and folds them. So no task holds more than a superblock of a tree and a path.
    """
    up = rounds(rows.select("tree", "idx", "n", F.col("leaf").alias("digest")), levels)
    roots = numbered(up[-1])
    over = rounds(roots.select("tree", "idx", "n", "digest"), levels)
    empty = F.lit(b"")
    down = over[-1].select("tree", "idx", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        down = paths(nodes, down, levels)
    down = (roots.join(down.drop("subroot", "tree"), "idx")
            .select(F.col("key_tree").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root"))
    for nodes in reversed(up[1:-1]):
        down = paths(nodes, down, levels)

    def finish(some: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        some, above = some.sort_values("idx"), above.iloc[0]
        given = [bytes(x) for x in some["leaf"]]
        tree = levels_of(given, int(some["n"].iloc[0]), levels)
        found = [steps(tree, i) + bytes(above["path"]) for i in range(len(given))]
        folded = [fold(x if c is None else bytes(c), p) for x, c, p in zip(given, some["claim"], found)]
        return pd.DataFrame({"key": some["key"], "doc_id": some["doc_id"], "leaf": some["leaf"], "subroot": above["subroot"],
                             "root": above["root"], "path": found, "folded": folded})

    return blocked(rows, levels).groupBy("tree", "block").cogroup(down.groupBy("tree", "idx")).applyInPandas(
        finish, "key string, doc_id long, leaf binary, subroot binary, root binary, path binary, folded binary")


def manifest(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", key_col: str = "lang",
             changed: Mapping[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """`key`, `doc_id`, `leaf`, `subroot`, `root` (hex), `siblings` (the proof: hex, from leaf to root),
    `folded_root`, `verified` for every row of `docs`.

    A leaf is the digest of the row's `columns`. Per value of `key_col`, leaves in order of id (null first;
    rows that share one in order of their digests) are hashed two by two, an odd last one alone, until one is left;
    the tops, in order of key (null first), are hashed likewise to the root. A leaf alone in its tree is its top.
    `folded_root` is what the proof makes of the row with the values of `changed`, and
    `verified` says whether that is the root. Null, empty and very long values have digests like any
    other; repeated rows are leaves of their own; columns that are not named are not read. An
    empty table gives no rows.
    """
    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    found = proven(stored(leaves(docs, columns, id_col, key_col, changed), "places"), levels)
    return found.select("key", "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                        siblings(F.col("path")).alias("siblings"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
