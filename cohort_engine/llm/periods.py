"""Periodic runs of words: recursive splitting at rare words, then a scan by lag of what is left."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed, over_texts, pieces, raw

PERIODS = 3  # a run is at least so many times as long as its period
SHORTEST = 24  # words of a run, at least


def settled(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Start and words of the segments in which every word occurs PERIODS times or more.

    A word of a run occurs PERIODS times in it, so one that is rarer in its segment lies in no
    run there and splits it; with smaller segments, more words are rare. All words that are
    rare in the whole text split it at once. From then on a split counts the words of the
    smaller side only and takes them off the counts of the larger, so a text of n words
    costs n log n steps however often it is split. A run and both words next to it are
    in one segment or at its ends, so runs that are maximal there are so in the text.
    """
    counts, n = Counter(words), len(words)
    rare = {w for w, c in counts.items() if c < PERIODS}
    if len(rare) == len(counts):
        return
    cut = np.flatnonzero(np.fromiter(map(rare.__contains__, words), bool, n)) if rare else np.empty(0, np.int64)
    edges = np.concatenate([[-1], cut, [n]])
    for i in np.flatnonzero(np.diff(edges) > SHORTEST):
        start, end = int(edges[i]) + 1, int(edges[i + 1])
        for a, b in split(words[start:end]):
            yield start + a, words[start + a:start + b]


def split(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ends (first word, behind the last) of the settled parts of a segment."""
    counts = Counter(words)
    rare = [w for w, c in counts.items() if c < PERIODS]
    if not rare:
        yield 0, len(words)
        return
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    todo = [(0, len(words), counts, rare)]
    while todo:
        a, b, counts, rare = todo.pop()
        while rare and b - a >= SHORTEST:
            w = rare.pop()
            if not counts[w]:
                continue
            p = places[w][bisect_left(places[w], a)]
            small = (a, p) if p - a < b - p else (p + 1, b)
            gone = Counter(words[small[0]:small[1]])
            counts[w] -= 1
            if counts[w]:
                rare.append(w)
            for x, c in gone.items():
                counts[x] -= c
                if counts[x] < PERIODS:
                    rare.append(x)
            if small[1] - small[0] >= SHORTEST:
                todo.append((*small, gone, [x for x, c in gone.items() if c < PERIODS]))
            a, b = (p + 1, b) if small[0] == a else (a, p)
        if b - a >= SHORTEST:
            yield a, b


def lag_scan(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment.

    Lags are scanned by size: with grams of L words (L doubling), those above L / 2 and up to L.
    Within a run of period q in that range, each gram that starts at least q + L words before its
    end occurs again q words later and not earlier, as a shorter return would give the run a
    shorter period; the words around the run break this. So the runs of these
    periods are the stretches of grams that return at one and the same lag. Grams of 2L
    words are named by the pair of names of their halves, so names stand for words exactly.
    """
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    name, size, out = np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), 1, []
    while size // 2 + 1 <= len(words) // PERIODS:
        order = np.argsort(name, kind="stable")
        again = name[order[1:]] == name[order[:-1]]
        lag = np.zeros(len(name), np.int64)
        lag[order[:-1][again]] = (order[1:] - order[:-1])[again]
        lag[(lag <= size // 2) | (lag > size)] = 0
        edges = np.flatnonzero(np.diff(lag, prepend=-1, append=-1))
        first, period = edges[:-1], lag[edges[:-1]]
        length = edges[1:] - 1 - first + period + size
        ok = (period > 0) & (length >= np.maximum(SHORTEST, PERIODS * period))
        out += zip(first[ok].tolist(), length[ok].tolist(), period[ok].tolist())
        rest = len(name) - size
        if rest <= 0:
            break
        name = np.unique(name[:rest] * (name.max() + 1) + name[size:], return_inverse=True)[1]
        size *= 2
    return out


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, by start and period."""
    return sorted(((start + a, n, q) for start, part in settled(words) for a, n, q in lag_scan(part)), key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length per period; of equal ones the first, then the shortest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    start, length, period = np.array(found).T
    change = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  prepared: Callable[[int | None, list[bytes]], list[bytes]] = lambda _, words: words) -> DataFrame:
    """`doc_id`, `n_runs`, `runs` (start, length, period, by start and period), `best` (the one of the
    greatest length per period; of equal ones the first start, then the shortest period; null
    without one), `collapsed` (the words that no run holds after its first period, joined by one space).

    A run is a longest stretch of words in which words a period apart are identical, of
    SHORTEST words and PERIODS periods at least; `period` is its smallest. `prepared` may change
    the words of a document first. Each row is dealt with by itself, so there is no shuffle;
    repeated rows give equal results. Null, empty and blank texts have no words and no run; whole texts are
    looked at, whatever their length. Other columns are not read; an empty table gives no rows.
    """
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batch):
        ids = batch.column(2)
        rows, held = [], 0
        for doc, text in zip(ids.to_pylist(), raw(batch.column(3))):
            words = prepared(doc, [w for p in pieces(text) for w in p.split()])
            found = runs(words)
            rows.append((doc, len(found), found, strongest(found), b" ".join(collapsed(words, found)).decode()))
            held += len(text)
            if held >= 1 << 24:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows):
        doc, n, found, best, kept = zip(*rows)
        named = [[dict(zip(("start", "length", "period"), r)) for r in some] for some in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(named, pa.list_(shape)),
             pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], shape), pa.array(kept, pa.string())],
            ["doc_id", "n_runs", "runs", "best", "collapsed"])

    run = "struct<start: bigint, length: bigint, period: bigint>"
    return over_texts(keyed(docs, id_col, text_col), scan, f"doc_id long, n_runs long, runs array<{run}>, best {run}, collapsed string")


def digested(found: DataFrame) -> DataFrame:
    """`doc_id`, `n_runs`, the best run's `start`, `length`, `period`, `exponent_milli`, and digests of the rest."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
