"""Repeated passages, found through an index of phrases that are cut where the words say."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from ..operators.keys import attach, members
from .common import ODD_2, Ranges, gram_hashes, keyed, over_texts, pieces, raw, signed, spread, stored, word_hashes

SEED_WORDS = 8  # words of a seed; every window of a phrase holds the phrase's seed
SHIFT = 16  # bits of a packed place that count the starts after the first
BLOCK = 1 << 18  # windows of a text that are looked at together


def phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut a text into phrases: seed hash, phrase hash, first and last window start.

    The seed of a window is the least hash of SEED_WORDS words inside it, the leftmost if
    several are equal, so equal windows have equal seeds at equal places. A phrase is a
    run of windows with the seed at the same place in the text.
    """
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    seed = min(SEED_WORDS, window)
    grams, ranges, out = gram_hashes(words, seed), Ranges(words), []
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        at = sliding_window_view(grams[a:b + window - seed], window - seed + 1).argmin(axis=1) + np.arange(a, b)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], b - a) - 1
        out.append((grams[at[first]], ranges.hashes(first + a, last + a + window), first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*out))


def packed(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """First and last window start of a phrase as one long."""
    return (s0 << SHIFT) | (s1 - s0)


def unpacked(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.asarray(at, np.int64)
    return both >> SHIFT, (both >> SHIFT) + (both & ((1 << SHIFT) - 1))


def index(docs: DataFrame, window: int) -> DataFrame:
    """All phrases of `docs` (of `keyed`): `seed`, `phrase`, `k_id`, `k_text`, `at` (packed starts)."""
    def scan(batch):
        found = [phrases(word_hashes(t), window) for t in raw(batch.column(3))]
        counts = [len(f[0]) for f in found]
        keys = spread({"k_id": batch.column(0).to_numpy(), "k_text": batch.column(1).to_numpy()}, counts)
        seed, phrase, s0, s1 = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([signed(seed), signed(phrase), *keys.values(), pa.array(packed(s0, s1))],
                                         ["seed", "phrase", "k_id", "k_text", "at"])

    return over_texts(docs, scan, "seed long, phrase long, k_id long, k_text long, at long")


def boundary_windows(docs: DataFrame, open_phrases: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of the phrases to check: `h1`, `h2`, `k_id`, `k_text`, `start`."""
    def scan(batch):
        out = []
        for t, ranges in zip(raw(batch.column("text")), batch.column("ranges").to_pylist()):
            words = word_hashes(t)
            at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(*unpacked(ranges))]))
            out.append((Ranges(words).hashes(at, at + window), Ranges(words, ODD_2).hashes(at, at + window), at))
        keys = spread({"k_id": batch.column("k_id").to_numpy(), "k_text": batch.column("k_text").to_numpy()},
                      [len(o[0]) for o in out])
        h1, h2, at = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([signed(h1), signed(h2), *keys.values(), pa.array(at)],
                                         ["h1", "h2", "k_id", "k_text", "start"])

    wanted = open_phrases.groupBy("k_id", "k_text").agg(F.collect_set("at").alias("ranges"))
    some = docs.join(wanted, ["k_id", "k_text"]).select("k_id", "k_text", "text", "ranges")
    return over_texts(some, scan, "h1 long, h2 long, k_id long, k_text long, start long")


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """`k_id`, `k_text`, `at` (packed starts): windows whose words start anywhere else too."""
    phrase = stored(index(docs, window), "phrases", drop_shuffles=True)
    # Equal windows have equal seeds, so phrases whose seed occurs once are done with. A common seed gives
    # very many rows of one key: `attach` and `members` let adaptive execution split them.
    seeds = phrase.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), (F.min("phrase") < F.max("phrase")).alias("differs"))
    again = stored(attach(phrase, seeds.filter("n > 1").select("seed", "differs"), "seed", "inner", null_safe=False),
                   "repeated", drop_shuffles=True)
    # A seed with different phrases around it: some may have copies, and their windows may still agree in part.
    unsure = again.filter("differs")
    # Any one place stands for a phrase; which one it is makes no difference.
    entry = unsure.groupBy("seed", "phrase").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("k_id", "k_text", "at")))
    copied = entry.filter("n > 1").select("seed", "phrase")
    whole = again.filter(~F.col("differs")).unionByName(members(unsure, copied, ["seed", "phrase"])).select("k_id", "k_text", "at")
    windows = stored(boundary_windows(docs, entry.select("k_id", "k_text", "at"), window), "windows", drop_shuffles=True)
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    part = members(windows, often, ["h1", "h2"]).select("k_id", "k_text", F.shiftleft("start", SHIFT).alias("at"))
    return whole.unionByName(part)


def factors(s0: np.ndarray, s1: np.ndarray, window: int) -> np.ndarray:
    """Maximal factors (start, end in words) from ranges of window starts, taken greedily
    from left to right: a factor goes on while the next repeated window overlaps it."""
    order = np.argsort(s0, kind="stable")
    s0, ends = s0[order], np.maximum.accumulate(s1[order] + window)
    new = np.flatnonzero(np.append(True, s0[1:] > ends[:-1]))
    return np.column_stack([s0[new], ends[np.append(new[1:], len(s0)) - 1]])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `n_factors`, `kept` (the kept words joined by one space).

    Not a Lempel-Ziv parse: to factor each document against every block of the corpus would take its
    square. Documents are cut into phrases at content-defined seeds, and each phrase meets only the
    hash partition that can hold its copies. A phrase that occurs elsewhere is repeated as a
    whole. Where a seed occurs with different phrases, parts of them may still agree: there each
    window is looked up by itself. Words in repeated windows are removed, in every place where
    they occur; `n_factors` counts the stretches that they make up. A text shorter than `window`
    words, empty or null keeps its words, whole texts are looked at whatever their length, and an empty
    table gives no rows. A repeated row is a second occurrence of all its windows. Other columns are not
    read. Equality is that of 128 bits of hashes.
    """
    texts = keyed(docs, id_col, text_col)
    spans = stored(repeated_spans(texts, window).groupBy("k_id", "k_text")
                   .agg(F.collect_set("at").alias("ranges")), "spans", drop_shuffles=True)

    def apply(batch):
        out = []
        for t, ranges in zip(raw(batch.column("text")), batch.column("ranges").to_pylist()):
            words = [w for p in pieces(t) for w in p.split()]
            spans = factors(*unpacked(ranges), window) if ranges else []
            kept, at = [], 0
            for start, end in spans:
                kept += words[at:start]
                at = end
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), len(spans), b" ".join(kept).decode()))
        n, gone, found, kept = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(found, pa.int64()),
             pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "n_factors", "kept"])

    joined = texts.join(spans, ["k_id", "k_text"], "left").select("doc_id", "text", "ranges")
    return over_texts(joined, apply, "doc_id long, n_words long, n_removed long, n_factors long, kept string")
