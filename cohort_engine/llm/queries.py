"""The operators as queries over the given tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from . import exact, language, lines, merkle, mixing, periods, pii, quality, simhash, substrings, tiling, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder of the tables) under its name."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, by classifiers fitted on those that are not held out."""
    return language.identify(table(spark, folder, "documents"))


@query()
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark item that covers each document most, and the verdict."""
    return tiling.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts and digest of the patterns' spans, and all spans."""
    return pii.find(table(spark, folder, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS i FROM d),
    h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM s),
    p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM h WHERE c > 1),
    r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
    q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
          FROM d LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.7 * n_lines
                OR word_chars < 2.0 * n_words OR word_chars > 20.0 * n_words) AS kept FROM b""")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.assess(table(spark, folder, "documents")).drop("rejected_by")


@query("""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i FROM d),
    h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM s),
    r AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN r USING (x)),
    p AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
               [w[j] for j in list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)))] END, ' ')) AS kept_sha256
    FROM d LEFT JOIN p USING (doc_id)""")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stay when repeated passages of 35 words go."""
    return substrings.deduplicate(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
    WITH d AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x}) AS l FROM documents),
    c AS (SELECT doc_id, text, l, list_filter(l, lambda x: regexp_matches(x.x, '[^ \t-\r]')) AS k FROM d),
    w AS (SELECT doc_id, k, unnest(range(1, greatest(len(k) - 2, 0) + 1)) AS p FROM c),
    h AS (SELECT doc_id, p, k[p].i AS a, k[p + 1].i AS b, k[p + 2].i AS e,
                 row_number() OVER (PARTITION BY k[p].x, k[p + 1].x, k[p + 2].x ORDER BY doc_id, p) AS o FROM w),
    g AS (SELECT doc_id, unnest([a, b, e]) AS i FROM h WHERE o > 1),
    q AS (SELECT doc_id, list_distinct(list(i)) AS gone FROM g GROUP BY doc_id)
    SELECT doc_id, CAST(len(k) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE
               array_to_string([x.x for x in list_filter(l, lambda x: NOT list_contains(gone, x.i))], chr(10)) END) AS kept_sha256
    FROM c LEFT JOIN q USING (doc_id)""")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that stay when repeated runs of three lines go."""
    return lines.deduplicate(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
    WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
                      md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
    l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
          FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
    v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM v) * weight) AS target FROM l),
    q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, before + copy * source_size AS a, before + copy * source_size + size AS b FROM q, (SELECT unnest([0, 1, 2]) AS copy)),
    k AS (SELECT *, greatest(a, least(b, floor(target))) AS cut FROM c),
    p AS (SELECT doc_id, u, copy, a, cut AS b, target FROM k UNION ALL SELECT doc_id, u, copy, cut, b, target FROM k),
    o AS (SELECT doc_id, b - a AS words, coalesce(sum(b - a) OVER (ORDER BY CASE WHEN target > 0 THEN CAST(b AS DOUBLE) / target ELSE 0 END, u, copy
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p WHERE b > a),
    f AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT sum(source_size) FROM s) - ahead))) AS taken FROM o GROUP BY doc_id)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN f USING (doc_id)""")
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = table(spark, folder, "documents")
    rows = mixing.shares(docs)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    """The public tokenizer that the token queries use."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from files."""
    return tokens.round_trip(table(spark, folder, "documents"), tokenizer_path())


# Base 32 of a SHA-1, five hex digits (20 bits) at a time.
BASE32_SQL = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '')"""


@query(f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS least FROM p)
    SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, {BASE32_SQL} AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM g""")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of archives just written from all pages."""
    return warc.round_trip(table(spark, folder, "pages"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, chosen by id, with their end made periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not words or h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every document, and what is left when each is cut to its first period."""
    return periods.digested(periods.periodic_runs(table(spark, folder, "documents"), prepared=repeated_tail))


def part_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


# The columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_sql(**changed: str) -> str:
    return "sha256(" + " || ".join(part_sql(f"CAST({changed.get(c, c)} AS VARCHAR)") for c in LEAF_COLUMNS) + ")"


@query(f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, lang, {leaf_sql()} AS leaf, {leaf_sql(n_chars="(n_chars + 1)")} AS other, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
               flatten([[CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for x in string_split(CAST(doc_id AS VARCHAR), '')])),
               lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))) AS crc FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
                 CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN other ELSE leaf END AS claim FROM d),
    t AS (SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM p UNION ALL
          SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
    s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM t WHERE n = 1),
    u AS (SELECT 0 AS lvl, place AS idx, m AS n, subroot AS digest FROM s UNION ALL
          SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2, n),
    f AS (SELECT doc_id, lang, leaf, 0 AS lvl, idx, n, claim AS digest, '' AS proof FROM p UNION ALL
          SELECT f.doc_id, f.lang, leaf, f.lvl + 1, f.idx // 2, (f.n + 1) // 2,
                 sha256(CASE WHEN o.digest IS NULL THEN f.digest WHEN f.idx % 2 = 0 THEN f.digest || o.digest ELSE o.digest || f.digest END),
                 proof || coalesce(o.digest, '')
          FROM f LEFT JOIN t o ON f.lang IS NOT DISTINCT FROM o.lang AND f.lvl = o.lvl AND xor(f.idx, 1) = o.idx WHERE f.n > 1),
    g AS (SELECT doc_id, leaf, subroot, 0 AS lvl, place AS idx, m AS n, digest, proof
          FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang WHERE f.n = 1 UNION ALL
          SELECT doc_id, leaf, subroot, g.lvl + 1, g.idx // 2, (g.n + 1) // 2,
                 sha256(CASE WHEN o.digest IS NULL THEN g.digest WHEN g.idx % 2 = 0 THEN g.digest || o.digest ELSE o.digest || g.digest END),
                 proof || coalesce(o.digest, '')
          FROM g LEFT JOIN u o ON g.lvl = o.lvl AND xor(g.idx, 1) = o.idx WHERE g.n > 1)
    SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, g.digest AS folded_root, g.digest = u.digest AS verified
    FROM g, u WHERE g.n = 1 AND u.n = 1""")
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy of it, some changed, is proven."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.col("n_chars") + hit.cast("int")
    found = merkle.manifest(table(spark, folder, "documents"), LEAF_COLUMNS, changed={"n_chars": changed})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


@query("""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""")
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays of each document's group of equal texts."""
    return exact.duplicates(table(spark, folder, "documents")).drop("k_id", "k_text")
