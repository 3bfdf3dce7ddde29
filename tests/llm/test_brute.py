"""The text operators against plain computations, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_engine.llm import language, mixing, pii, quality, simhash, substrings, tiling
from cohort_engine.llm.queries import ORACLES, QUERIES, tokenizer_path
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLES[name]) is None


def components(texts):
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams = [" ".join(words[j:j + 4]) for j in range(len(words) - 3)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    label = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return prints, label


def test_components(spark, docs, texts):
    prints, label = components(texts)
    want = {(i, f"{prints[i]:016x}", label[i]) for i in texts}
    assert {tuple(r) for r in QUERIES["op1_simhash_near_dedup"](spark, FOLDER).collect()} == want
    assert {tuple(r) for r in simhash.near_duplicates(docs, shard_rows=10).collect()} == want


def near_pairs(points):
    return {(a, b) for a in points.tolist() for b in points.tolist() if a < b and (a ^ b).bit_count() <= 4}


def shard_pairs(points, leaf):
    """Pairs that meet in a shard and the sizes of all shards."""
    found, sizes = set(), []
    for mask in simhash.HALVES:
        for _, home, guest in simhash.route(simhash.plant(points, mask, leaf), points, 2, 4):
            h, g = points[home].tolist(), points[np.concatenate([home, guest])].tolist()
            found |= {(min(a, b), max(a, b)) for a in h for b in g if a != b and (a ^ b).bit_count() <= 4}
            sizes.append(len(home))
    return found, sizes


def test_shards_lose_no_link():
    draw = np.random.default_rng(1)
    centers = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([centers ^ (np.uint64(1) << draw.integers(0, 64, 60).astype(np.uint64)) for _ in range(40)] + [centers]))
    near = near_pairs(points)
    assert shard_pairs(points, 8)[0] == near and len(near) > 1000


def test_equal_halves_are_split():
    """Fingerprints that share one half, where no radius by that half splits them."""
    draw = np.random.default_rng(6)
    low = draw.choice(1 << 12, 800, replace=False).astype(np.uint64)
    for points in (low, low << np.uint64(32)):
        found, sizes = shard_pairs(points, 8)
        assert found == near_pairs(points) and max(sizes) <= 8


def test_tiles():
    draw = random.Random(3)
    for _ in range(200):
        item = [draw.randrange(6) for _ in range(draw.randrange(5, 25))]
        doc = [draw.randrange(6) for _ in range(10)] + item[draw.randrange(3):] + [draw.randrange(6) for _ in range(8)] + item[:9]
        k = 3
        seeds = [hash(tuple(item[i:i + k])) for i in range(len(item) - k + 1)]
        hits = [(i, hash(tuple(doc[i:i + k]))) for i in range(len(doc) - k + 1)]
        found = tiling.tiles(hits, seeds, len(item), k)
        used_item, used_doc, want = set(), set(), []
        while True:  # the longest match of unmarked words, by looking at all
            best = None
            for a in range(len(doc)):
                for b in range(len(item)):
                    n = 0
                    while (a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]
                           and a + n not in used_doc and b + n not in used_item):
                        n += 1
                    if n >= k and (best is None or n > best[2]):
                        best = (a, b, n)
            if best is None:
                break
            want.append(best[2])
            used_doc |= set(range(best[0], best[0] + best[2]))
            used_item |= set(range(best[1], best[1] + best[2]))
        assert found[0][2] == want[0] and all(doc[a:a + n] == item[b:b + n] for a, b, n in found)
        places = [p for a, _, n in found for p in range(a, a + n)]
        assert len(places) == len(set(places))


def plain_words(text):
    text = "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in text.lower())
    return regex.sub(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", r" \g<0> ", text).split()


def plain_tiling(doc, item, k):
    """Words in tiles and their number: the longest match of unmarked words again and again, by looking at all."""
    in_doc, in_item, covered, n_tiles = set(), set(), 0, 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in in_doc and i + n not in in_item):
                    n += 1
                if n >= k and (best is None or (-n, i, d - i) < best):
                    best = (-n, i, d - i)
        if best is None:
            return covered, n_tiles
        n, i, d = -best[0], best[1], best[2] + best[1]
        in_doc |= set(range(d, d + n))
        in_item |= set(range(i, i + n))
        covered, n_tiles = covered + n, n_tiles + 1


def plain_contamination(texts, items, size=5):
    out = set()
    for i, t in texts.items():
        doc, found = plain_words(t or ""), []
        grams = {m: {tuple(doc[j:j + m]) for j in range(len(doc) - m + 1)} for m in range(1, size + 1)}
        for item_id, text in items:
            item = plain_words(text or "")
            k = min(size, len(item))
            if item and any(tuple(item[j:j + k]) in grams[k] for j in range(len(item) - k + 1)):
                covered, n_tiles = plain_tiling(doc, item, k)
                found.append((-covered / len(item), item_id, n_tiles))
        c, item_id, n_tiles = min(found, default=(0.0, None, 0))
        out.add((i, len(found), item_id, -c, n_tiles, -c >= 0.5))
    return out


def test_op3_against_all_pairs(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op3_benchmark_decontamination"](spark, FOLDER).collect()}
    assert got == plain_contamination(texts, items) and sum(r[-1] for r in got) >= 3


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Answer is forty two"), (2, "\u5317\u4eac\u662f\u4e2d\u56fd\u7684\u9996\u90fd"), (3, "one"), (4, ""), (5, "a b c d e f g h i j")]
    docs = {1: "well, the answer is forty two!", 2: "\u6211\u77e5\u9053\u5317\u4eac\u662f\u4e2d\u56fd\u7684\u9996\u90fd\u3002", 3: "answer forty is two",
            4: "f g h i j and a b c d e", 5: "\u5317\u4eac", 6: "", 7: "One"}
    given = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {tuple(r) for r in tiling.contamination(given, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_contamination(docs, items)
    assert {r[0] for r in got if r[-1]} == {1, 2, 4, 7}
    kept = tiling.decontaminated(given, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("k_id", F.lit("x")))
    assert {r["doc_id"] for r in kept.collect()} == {3, 5, 6}


def test_contamination_finds_reordered_passages(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    some = items.orderBy("item_id").limit(5).collect()
    planted = []
    for i, r in enumerate(some):
        words = r["text"].split()
        half = len(words) // 2
        planted.append((10_000 + i, "Intro words here. " + " ".join(words[half:]) + " and then " + " ".join(words[:half]).upper()))
    given = spark.createDataFrame(planted, "doc_id long, text string")
    got = tiling.contamination(given, items).collect()
    assert all(r["contaminated"] and r["item_id"] == some[r["doc_id"] - 10_000]["item_id"] for r in got)


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op2_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 0


def plain_features(text):
    """Roots of the shares of hashed 1 to 3-byte grams, a gram at a time."""
    part = "".join(" " if ord(c) < 128 and not c.isalpha() else c for c in text)
    b, counts = (" " + re.sub(" +", " ", part).lower() + " ").encode(), {}
    for i, x in enumerate(b):
        places = [x]
        if i + 1 < len(b):
            pair = x * 257 + b[i + 1]
            places.append(256 + pair * 2654435761 % 2**32 % 2816)
        if i + 2 < len(b):
            places.append(3072 + ((pair * 263 + b[i + 2]) % 2**32 * 2654435761 % 2**32 >> 7) % (language.DIMS - 3072))
        for p in places:
            counts[p] = counts.get(p, 0) + 1
    total = sum(counts.values())
    return {p: math.sqrt(c / total) for p, c in counts.items()}


def test_op2_against_plain_decoding(spark, docs, texts):
    """Bits and loss-weighted decoding of every row, one by one, by the model that the query fits."""
    model = language.train(docs.filter(~language.held_out("doc_id")))
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        x = plain_features(t)
        margin = [sum(v * float(model.w[p, k]) for p, v in x.items()) + float(model.b[k]) for k in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margin, code)) / max(1, len(code) / 4) for code in model.code.tolist()]
        best = min(range(len(loss)), key=loss.__getitem__)
        p = [math.exp(loss[best] - x) for x in loss]
        assert got[i]["lang_pred"] == model.langs[best] and got[i]["score"] == pytest.approx(1 / sum(p), abs=2e-3)
        others = sorted(p)[-2] / sum(p) if len(p) > 1 else 0
        if abs(1 / sum(p) - others - 0.2) > 0.01:
            assert got[i]["ambiguous"] == (1 / sum(p) - others < 0.2)


def test_many_languages_are_all_learned(spark):
    """1,500 languages, some of a single row and one of half of all rows, with few rows in all."""
    rows = spark.range(0, 9_000, 1, 4).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'l0' ELSE concat('l', id % 1500) END AS lang",
                                                  "concat('text ', id % 1500, ' of words') AS text").unionByName(
        spark.range(1500).selectExpr("id + 10000 AS doc_id", "concat('l', id) AS lang", "concat('more ', id) AS text"))
    model = language.train(rows, max_rows=2_000, rounds=2)
    assert len(model.langs) == 1500 and model.code.shape[0] == 1500
    found = language.predict(rows.limit(50), model).collect()
    assert len(found) == 50 and all(r["lang_pred"] in model.langs and 0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 40])
def test_codebook(n):
    code = language.codebook(n)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert len(code) == n and (n == 1 or min(apart) >= 1) and (n < 3 or min(apart) >= 2)


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans(texts):
    draw = random.Random(1)
    fuzz = ["".join(draw.choice("ab1234567890.@+- (),é") for _ in range(draw.randrange(60))) for _ in range(5_000)]
    for t in [*texts.values(), *fuzz]:
        assert pii.base_spans(t)[0] == plain_spans(t)


def test_tagger_gradient():
    tagger, draw = pii.Tagger(size=3, hidden=2), np.random.default_rng(0)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    windows, tags = draw.integers(1, 60, (4, 7)), np.array([[0, 1, 2, 2, 0, 3, 4]] * 4)

    def loss():
        e, _ = tagger.scores(windows)
        step = tagger.p["step"] + tagger.refuse
        e[0, :, 2::2] -= 1e4
        total, gold = e[0], e[0][np.arange(4), tags[:, 0]]
        for t in range(1, 7):
            total = np.log(np.exp(total[:, :, None] + step - 50).sum(1)) + 50 + e[t]
            gold = gold + step[tags[:, t - 1], tags[:, t]] + e[t][np.arange(4), tags[:, t]]
        return (np.log(np.exp(total - 50).sum(1)) + 50 - gold).mean()

    grad = tagger.gradient(windows, tags)
    for name, place in (("out", (1, 2)), ("hf", (0, 3)), ("xb", (2, 1)), ("step", (1, 2)), ("bb", (4,))):
        old = tagger.p[name][place]
        tagger.p[name][place] = old + 1e-3
        up = loss()
        tagger.p[name][place] = old - 1e-3
        down = loss()
        tagger.p[name][place] = old
        assert grad[name][place] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_tagger_on_held_out_windows(spark):
    rows = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(5_000).collect()]
    kinds = {}
    for t in rows[:4_000]:
        starts = pii.window_starts(t)
        for w, g in zip(pii.cut_windows(t, starts), pii.tagged(t, pii.base_spans(t)[0], starts) if starts else ()):
            kinds.setdefault(int(g.max() + 1) // 2, []).append((w, g))
    windows, tags = map(np.stack, zip(*(x for some in kinds.values() for x in some[:150])))
    model = pii.Tagger().fit(*pii.varied(windows, tags.astype(np.int64)))
    right = found = wanted = 0
    for t in rows[4_000:]:
        starts = pii.window_starts(t)
        base = set(pii.base_spans(t)[0])
        got = set(pii.reconcile(t, starts, model.spans(pii.cut_windows(t, starts)), [], []))
        right, found, wanted = right + len(got & base), found + len(got), wanted + len(base)
    assert wanted > 30 and right >= 0.85 * found and right >= 0.6 * wanted


def test_refusals_veto_their_kind_only():
    text = "Call (555) 123-4567 or 1234 5678 9012 3456 now"
    base, refused = pii.base_spans(text)
    assert base == [] and {k for _, k, _ in refused} == {2}
    marked = [[(5, 3, 19), (23, 2, 42)]]
    assert pii.reconcile(text, [0], marked, base, refused) == [(5, 3, 19)]


MISSED = {"(###) ###-####": "phone", "###-###-####": "phone", "0### ### ####": "phone", "####.####.####.####": "card"}


def test_op4_adds_forms_that_no_pattern_finds(spark, tmp_path):
    """At least 0.8 of each form, with exact bounds, in words that are not those of the training windows; no dates or other numbers."""
    docs, draw, planted = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), np.random.default_rng(4), {}
    leads = ["Call me at ", "You can reach the office on ", "Contact: ", "Please note ", "We used ", "Ask for "]
    for form, kind in MISSED.items():
        for _ in range(40):
            lead, text = leads[draw.integers(len(leads))], pii.filled(form, pii.KINDS.index(kind), draw)
            planted[10_000_000 + len(planted)] = (form, f"{lead}{text} for more, and then some words follow here.", f"{kind}:{len(lead)}:{len(lead) + len(text)}")
    clean = {20_000_000 + i: f"It began with {pii.filled(('####-##-##', '##.##.####', '##:##', '#,###', '####')[i % 5], 9, draw)}, and nobody could say why so many came."
             for i in range(100)}
    more = spark.createDataFrame([*((i, t) for i, (_, t, _) in planted.items()), *clean.items()], "doc_id long, text string")
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["op4_personal_data"](spark, str(tmp_path)).collect()}
    got = {i: rows[i] for i in planted}
    assert all(r["n_phone"] == r["n_card"] == 0 for r in got.values())
    for form in MISSED:
        right = [got[i]["spans"] == want and got[i]["n_added"] == 1 for i, (f, _, want) in planted.items() if f == form]
        assert len(right) == 40 and sum(right) >= 32, (form, sum(right))
    assert sum(rows[i]["n_added"] for i in clean) <= 5


def test_op4_against_plain_patterns(spark, texts):
    """Counts and digest of every row; the tagger adds spans that overlap none and leaves all others."""
    for r in QUERIES["op4_personal_data"](spark, FOLDER).collect():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if x in set(base)] == base and r["n_added"] == len(spans) - len(base)
        places = [tuple(map(int, x.split(":")[1:])) for x in spans]
        added = [p for x, p in zip(spans, places) if x not in set(base)]
        assert places == sorted(places) and all(a >= d or b <= c for a, b in added for c, d in places if (a, b) != (c, d))


def test_phrases_share_seeds():
    words = np.random.default_rng(4).integers(0, 1 << 62, 300).astype(np.uint64)
    one, two = np.concatenate([words[:50], words[100:180]]), np.concatenate([words[200:230], words[100:180], words[60:90]])
    seeds = [set(substrings.phrases(w, 35)[0].tolist()) for w in (one, two)]
    assert seeds[0] & seeds[1]


def test_tokens(spark, texts):
    from tokenizers import Tokenizer
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, set()
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op9_token_files"](spark, FOLDER).collect()} == want


def test_word_encoder():
    from cohort_engine.llm.tokens import WordEncoder
    words, draw = WordEncoder(tokenizer_path()), random.Random(2)
    some = ["a", "B", "é", "É", "ß", "İ", "ı", "Σ", "ς", ".", ",", "!", "'s", "'", " ", "\n", "\t", "1", "<|endoftext|>", "́", "ÿ", "中", "\x1c", "it's", "_", "×"]
    for _ in range(5_000):
        text = "".join(draw.choice(some) for _ in range(draw.randrange(14)))
        assert words.encode(text.encode()) == words.ids(text).tobytes()


def test_rules_are_ordered_by_rejection_per_cost(spark):
    """Costs are measured: a costly rule that rejects most comes after a cheap one that rejects half of it."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words"), 200)).alias("text"))
    share = {"costly": 9, "cheap": 5, "cheap_rare": 1, "never": 0}

    def rejects(name):
        return lambda m: F.get(m.words, F.lit(0)).cast("int") % 10 < share[name]

    def costly(m):
        return (F.sha2(F.repeat(m.text, 200), 512) != "") & rejects("costly")(m)

    rules = [quality.Rule("never", rejects("never")), quality.Rule("costly", costly), quality.Rule("cheap_rare", rejects("cheap_rare")),
             quality.Rule("cheap", rejects("cheap"))]
    found = {n: (c, s) for n, c, s in quality.estimate(docs, rules, "doc_id", "text")}
    assert {n: round(10 * s) for n, (_, s) in found.items()} == share
    assert found["costly"][0] > 5 * max(found["cheap"][0], found["cheap_rare"][0])
    order = [r.name for r in quality.ordered(docs, rules)]
    assert order[0] == "cheap" and order[-1] == "never" and order.index("costly") > order.index("cheap")
    got = quality.assess(docs, rules=rules).collect()
    assert sum(r["rejected_by"] == "cheap" for r in got) == 200 and sum(r["rejected_by"] == "costly" for r in got) == 160
    assert quality.kept(docs, rules=rules).count() == 40


def test_pipeline_stages(spark, docs, texts):
    left = docs
    measured = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    left = corpus_pipeline.STAGES[0][1](spark, left, FOLDER)
    kept = {r["doc_id"] for r in left.collect()}
    assert kept == {i for i, k in measured.items() if k}
    _, label = components({i: texts[i] for i in kept})
    left = corpus_pipeline.STAGES[1][1](spark, left, FOLDER)
    assert {r["doc_id"] for r in left.collect()} == set(label.values())


def test_pipeline_mixes_whole_texts(spark, docs, texts):
    mixed = corpus_pipeline.mixture(spark, docs, FOLDER).collect()
    assert mixed and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    per = {r["source"]: r["target"] for r in mixing.shares(docs).select("source", "target").distinct().collect()}
    for source, target in per.items():
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed if r["source"] == source]
        assert abs(sum(sizes) - target) <= 0.5 * max(len(t.split()) for t in texts.values()) + 1


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
