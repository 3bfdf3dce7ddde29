"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, gram_hashes, key_id, key_text, keyed, over_texts, ship, signed, spread, word_hashes

BITMAP_BITS = 25  # 4 MB, whatever the size of the benchmark
TABLE = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(256))


BELOW_CJK = bytes(range(0xE0))  # bytes of UTF-8 that characters of up to two bytes have
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")


def normal(text: str | None) -> bytes:
    """Lower case, ASCII punctuation as white space; in scripts that are written without spaces
    each character is a word."""
    out = (text or "").lower().encode().translate(TABLE)
    if out.translate(None, BELOW_CJK):
        out = UNSPACED.sub(r" \g<0> ", out.decode()).encode()
    return out


def size_of_seeds(n_words: int, k: int) -> int:
    """Words of the seeds of an item: k, or all words of a shorter item."""
    return max(1, min(k, n_words))


def item_seeds(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """`item`, `n_words`, `seeds` (the hash of each k words in order, or of all of a shorter item)."""
    def scan(batch):
        words = [word_hashes(normal(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in words], pa.int64()),
             pa.array([gram_hashes(w, size_of_seeds(len(w), k)).view(np.int64) for w in words], pa.list_(pa.int64()))],
            ["item", "n_words", "seeds"])

    items = benchmark.select(key_id(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return over_texts(items, scan, "item long, n_words long, seeds array<long>").filter(F.size("seeds") > 0)


def bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each value that the first BITMAP_BITS of a seed can take; its size is fixed."""
    place = f"shiftrightunsigned(seed, {64 - BITMAP_BITS})"
    words = (seeds.select(F.expr(f"cast(shiftrightunsigned({place}, 6) as int)").alias("w"),
                          F.expr(f"shiftleft(1L, cast({place} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[[r["w"] for r in words]] = [r["b"] for r in words]
    return out.view(np.uint64)


def tiles(hits: list[tuple[int, int]], seeds: list[int], n_words: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item by a document: (place in document, place in item, words).

    `hits` are (place, seed) of the document. Seeds in step make up runs, the maximal
    matches. The longest run is marked, again and again; a run that a mark cuts is put back
    with what is left of it while that has k words.
    """
    places: dict[int, list[int]] = {}
    for i, s in enumerate(seeds):
        places.setdefault(s, []).append(i)
    diagonals: dict[int, list[int]] = {}
    for d, s in sorted(set(hits)):
        for i in places.get(s, ()):
            diagonals.setdefault(d - i, []).append(i)
    heap = []
    for diagonal, at in diagonals.items():
        start = last = at[0]
        for i in [*at[1:], None]:
            if i is not None and i == last + 1:
                last = i
                continue
            heap.append((-(last - start + k), start, diagonal))
            start = last = i
    heapq.heapify(heap)
    in_item, in_doc, out = bytearray(n_words), set(), []
    while heap:
        size, i, diagonal = heapq.heappop(heap)
        free = [not in_item[i + j] and i + j + diagonal not in in_doc for j in range(-size)]
        if all(free):
            out.append((i + diagonal, i, -size))
            for j in range(-size):
                in_item[i + j] = 1
                in_doc.add(i + j + diagonal)
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (-(j - start), i + start, diagonal))
                start = None
    return out


def matches(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", k: int = 5) -> DataFrame:
    """`k_id`, `k_text`, `item`, `n_tiles`, `coverage` for each text (of `keyed`) and item
    that share a seed of k words; coverage is the share of the item's words in tiles.

    A bitmap of fixed size passes over places whose seed no item can have; what passes is
    joined by its seed. Runs are put together from seeds, so no text is shuffled.
    """
    ship(docs.sparkSession)
    items = item_seeds(benchmark, item_col, item_text, k)
    by_seed = items.select("item", F.explode("seeds").alias("seed")).distinct()
    known = bitmap(by_seed)
    sizes = [r[0] for r in items.select(F.least(F.lit(k), "n_words")).distinct().collect()]  # k of them at most

    def scan(batch):
        at, seeds, counts = [], [], []
        for t in batch.column(3).to_pylist():
            words, n = word_hashes(normal(t)), 0
            for size in sizes:
                s = gram_hashes(words, size)
                place = s >> np.uint64(64 - BITMAP_BITS)
                hit = np.flatnonzero((known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                at.append(hit)
                seeds.append(s[hit])
                n += len(hit)
            counts.append(n)
        if not sizes:
            return
        keys = spread({"k_id": batch.column(0).to_numpy(), "k_text": batch.column(1).to_numpy()}, counts)
        yield pa.RecordBatch.from_arrays([*keys.values(), pa.array(np.concatenate(at)), signed(np.concatenate(seeds))],
                                         ["k_id", "k_text", "at", "seed"])

    hits = over_texts(docs, scan, "k_id long, k_text long, at long, seed long")
    pairs = (hits.join(by_seed, "seed").groupBy("k_id", "k_text", "item")
             .agg(F.collect_set(F.struct("at", "seed")).alias("hits")))

    def tile(batch):
        n_tiles, coverage = [], []
        for hits_of, seeds, n in zip(*(batch.column(c).to_pylist() for c in ("hits", "seeds", "n_words"))):
            found = tiles([(h["at"], h["seed"]) for h in hits_of], seeds, n, size_of_seeds(n, k))
            n_tiles.append(len(found))
            coverage.append(sum(t[2] for t in found) / n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k_id"), batch.column("k_text"), batch.column("item"), pa.array(n_tiles, pa.int64()),
             pa.array(coverage, pa.float64())], ["k_id", "k_text", "item", "n_tiles", "coverage"])

    return over_texts(pairs.join(items, "item"), tile, "k_id long, k_text long, item long, n_tiles long, coverage double")


def best_matches(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, k: int) -> DataFrame:
    """`k_id`, `k_text`, `n_items`, and of the item covered most `coverage`, `item`, `n_tiles`."""
    found = matches(docs, benchmark, item_col, item_text, k)
    best = F.min(F.struct((-F.col("coverage")).alias("c"), (F.col("item") == F.lit(NULL_ID)).alias("n"), "item", "n_tiles"))
    return (found.groupBy("k_id", "k_text").agg(F.count(F.lit(1)).alias("n_items"), best.alias("b"))
            .select("k_id", "k_text", "n_items", (-F.col("b.c")).alias("coverage"), "b.item", "b.n_tiles"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """`doc_id`, `n_items` (sharing a seed), `item_id` (covered most; of equal ones the least id),
    `coverage`, `n_tiles` of that item, `contaminated` (coverage of `threshold` or more).

    Words are compared in lower case without ASCII punctuation. Reordered passages are caught,
    as tiles may lie in any order. An item of fewer than k words is one seed, so it is found where all its
    words stand together; an item without a word matches nothing. Null texts count as empty; a null item id is an id like any other, the last in order.
    Rows equal in id and text get the same answer; an empty benchmark flags nothing.
    """
    texts = keyed(docs, id_col, text_col)
    best = best_matches(texts, benchmark, item_col, item_text, k)
    return texts.select("k_id", "k_text", "doc_id").join(best, ["k_id", "k_text"], "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.nullif("item", F.lit(NULL_ID)).alias("item_id"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"),
        (F.coalesce("coverage", F.lit(0.0)) >= threshold).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with their columns, that `contamination` does not flag.

    Null and empty texts stay, repeated rows stay or go together, and an empty benchmark or table
    changes nothing."""
    leaks = (best_matches(keyed(docs, id_col, text_col), benchmark, item_col, item_text, k)
             .filter(F.col("coverage") >= threshold).select("k_id", "k_text"))
    packed = docs.select(F.struct("*").alias("doc"), key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text"))
    return packed.join(leaks, ["k_id", "k_text"], "left_anti").select("doc.*")
