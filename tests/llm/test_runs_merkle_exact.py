"""Periodic runs, the Merkle manifest and exact duplicates: against plain computations, on edge
cases, and with a hot group."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohort_engine.llm import exact, merkle, periods
from cohort_engine.llm.queries import LEAF_COLUMNS, QUERIES, repeated_tail

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, tree string, runs string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows and ids, names that clash."""
    rows = [(1, "a b c " * 30, "en", "s", 5), (2, "a b c " * 30, "en", "s", 5), (3, "A B c " * 30, None, None, None), (4, None, "en", "s", 0),
            (5, "", None, "s", 1), (6, " \n\t ", "fr", "s", 1), (None, "a b c " * 30, "en", "s", 5), (None, None, None, None, None),
            (7, "One", "", "s", 3), (7, "One", "", "s", 3), (7, "Two", "", "s", 3), (8, "x y " * 100_000, "en", "", 7), (9, "Ä É", "de", "s", 1),
            (10, "ä é", "de", "s", 1), (-3, "one", "de", "s", -1)]
    return spark.createDataFrame([(*r, "d", "r", "t", "u", "k") for r in rows], SCHEMA).repartition(4)


# Periodic runs


def plain_runs(words):
    """By all starts, for all lags."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    listed, kept = "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    draw, found = random.Random(1), 0
    for _ in range(1_500):
        kinds, n = draw.choice([1, 2, 3, 5, 20]), draw.randrange(130)
        words = [b"%d" % draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randrange(4) if n > 2 else 0):  # periodic stretches, some across others
            a = draw.randrange(n)
            p, end = draw.randrange(1, 1 + max(1, (n - a) // 2)), a + draw.randrange(n - a + 1)
            for i in range(a + p, end):
                words[i] = words[i - p]
        want = plain_runs(words)
        assert periods.runs(words) == want
        found += len(want)
    assert found > 300


def test_segments_are_settled():
    draw = random.Random(5)
    for _ in range(400):
        words = [b"%d" % min(draw.randrange(40), draw.randrange(40)) for _ in range(draw.randrange(400))]
        left, todo = set(), [(0, len(words))]
        while todo:  # split at every rare word until none is left
            a, b = todo.pop()
            rare = [i for i in range(a, b) if words[a:b].count(words[i]) < 3]
            if rare:
                todo += zip([a, *(i + 1 for i in rare)], [*rare, b])
            elif b - a >= 24:
                left.add((a, b))
        assert {(s, s + len(part)) for s, part in periods.settled(words)} == left


def test_splitting_one_by_one_stays_fast():
    """Every split makes just one more word rare: n rounds over all that is left would be the square of n."""
    n = 30_000
    words = [b"s"] + [x for i in range(n) for x in (b"%d" % i, b"%d" % (i + 1), b"%d" % i)]
    assert list(periods.settled(words)) == []


def test_op11_against_all_lags(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert got == {plain_row(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_edges(docs):
    got = periods.digested(periods.periodic_runs(docs, prepared=repeated_tail))
    rows = docs.filter("n_chars <> 7 or n_chars is null").select("doc_id", "text").collect()
    assert sorted(map(str, (tuple(r) for r in got.filter("coalesce(doc_id, 0) <> 8").collect()))) == sorted(str(plain_row(*r)) for r in rows)
    long = periods.periodic_runs(docs).filter("doc_id = 8").first()
    assert [tuple(r) for r in long["runs"]] == [(0, 200_000, 2)] and long["collapsed"] == "x y"
    assert periods.periodic_runs(docs.limit(0)).count() == 0


# The Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, change):
    """Rows are dicts; (doc_id, leaf, subroot, root, siblings, folded, verified) of each."""
    trees, top = {}, []
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf([r[c] for c in LEAF_COLUMNS]), r))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda x: x[:3])
        top.append(plain_tree([x[2] for x in trees[k]]))
    upper, out = plain_tree([t[-1][0] for t in top]), []
    for at, k in enumerate(keys):
        for i, (_, _, leaf, r) in enumerate(trees[k]):
            digest, found = plain_leaf([change(r)[c] for c in LEAF_COLUMNS]), []
            for levels, j in ((top[at], i), (upper, at)):
                for level in levels[:-1]:
                    other = level[j ^ 1] if j ^ 1 < len(level) else ""
                    found += [other] * bool(other)
                    digest = h(digest, other) if j % 2 == 0 else h(other, digest)
                    j //= 2
            out.append((r["doc_id"], leaf, top[at][-1][0], upper[-1][0], tuple(found), digest, digest == upper[-1][0]))
    return out


def plus_one(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
    return {**r, "n_chars": r["n_chars"] + 1} if hit else r


def manifest(docs, levels=merkle.LEVELS):
    changed = F.expr("n_chars + if(coalesce(crc32(cast(doc_id as string)) % 7 = 0, false), 1, 0)")
    found = merkle.manifest(docs, LEAF_COLUMNS, changed={"n_chars": changed}, levels=levels).drop("key")
    return sorted(((*r[:4], tuple(r[4]), *r[5:]) for r in found.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_over_superblocks(spark, levels):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = manifest(docs, levels)
    assert got == sorted(plain_manifest([r.asDict() for r in docs.collect()], plus_one), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_edges(spark, docs, levels):
    assert manifest(docs, levels) == sorted(plain_manifest([r.asDict() for r in docs.collect()], plus_one), key=str)
    assert manifest(docs.limit(0), levels) == []
    one = docs.filter("doc_id = 1")
    leaf = plain_leaf([one.first()[c] for c in LEAF_COLUMNS])
    assert merkle.manifest(one, LEAF_COLUMNS).drop("key").collect() == [(1, leaf, leaf, leaf, [], leaf, True)]


def test_manifest_of_many_keys(spark):
    """More keys than a superblock has nodes, and one key of a third of the rows."""
    rows = spark.range(1200).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 97) END AS lang",
                                        "'s' AS source", "id AS n_chars", "'t' AS text")
    assert manifest(rows, 2) == sorted(plain_manifest([r.asDict() for r in rows.collect()], plus_one), key=str)


def test_any_other_value_breaks_the_proof(spark, docs):
    some = docs.filter("doc_id is not null and doc_id < 7")
    for c, value in (("text", F.lit("other")), ("source", F.lit("z")), ("lang", F.lit("zz")), ("doc_id", F.col("doc_id") + 100)):
        assert not any(r["verified"] for r in merkle.manifest(some, LEAF_COLUMNS, changed={c: value}).collect())


# Exact duplicates


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_edges(spark, docs):
    got = exact.duplicates(docs).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(lowered(r["text"]), []).append(r["doc_id"])
    want = [(i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted({w[3] for w in want})  # one row of each group
    assert exact.duplicates(docs.limit(0)).count() == 0
    first = exact.deduplicated(docs)
    assert first.columns == docs.columns and first.count() == len(groups)
    assert sorted(lowered(r["text"]) for r in first.collect()) == sorted(groups)


def test_exact_hot_group(spark, monkeypatch):
    """A text of a third of the rows is a winner of the summary and goes through no exchange."""
    docs = spark.range(0, 60_000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot text' ELSE concat('t', id % 30011) END AS text")
    rows = exact.digests(docs, "doc_id", "text")
    named = exact.frequent(rows)
    assert named.count() <= exact.HEAVY
    assert named.join(rows.filter("doc_id = 0").select(F.xxhash64("digest").alias("item")), "item").count() == 1
    got = {r["doc_id"]: r for r in exact.duplicates(docs).collect()}
    groups = {}
    for i in range(60_000):
        groups.setdefault("hot text" if i % 3 == 0 else f"t{i % 30011}", []).append(i)
    assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), i == max(g)) for g in groups.values() for i in g)


def test_summary_misses_no_frequent_digest(spark, monkeypatch):
    """With few counters: rows of many tasks, in each of which the frequent digests are rare."""
    monkeypatch.setattr(exact, "COUNTERS", 64)
    monkeypatch.setattr(exact, "HEAVY", 8)
    rows = spark.range(0, 40_000, 1, 32).select(
        F.when(F.col("id") % 4 == 0, F.lit("a")).when(F.col("id") % 4 == 1, F.lit("b")).otherwise(F.col("id").cast("string")).cast("binary").alias("digest"))
    named = {r["item"] for r in exact.frequent(rows).collect()}
    hot = spark.sql("select xxhash64(cast('a' as binary)) a, xxhash64(cast('b' as binary)) b").first()
    assert len(named) <= 8 and {hot["a"], hot["b"]} <= named
