"""Near-duplicates by SimHash: fingerprints within a few bits, found through vantage-point trees."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import keys
from .common import attach, checkpoint, keyed, over_texts, pieces, raw, signed
from .components import components

SEED = 42
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the shingles of a text, repeats included; 0 if it has no word."""
    counts, total, rest = np.zeros((8, 256), np.int64), 0, []
    for piece in pieces(text):
        words = rest + piece.lower().split()
        n = len(words) - shingle + 1
        if n > 0:
            grams = map(b" ".join, zip(*(words[j:n + j] for j in range(shingle))))
            counts += _lanes(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
            total += n
        rest = words[max(n, 0):]
    if not total:
        if not rest:
            return 0
        counts += _lanes(np.array([xxhash.xxh64_intdigest(b" ".join(rest), SEED)], np.uint64))
        total = 1
    bits = (counts @ BITS).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """How often each byte lane of the hashes holds each value."""
    lanes = hashes.view(np.uint8).reshape(-1, 8) + LANES
    return np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """`k_id`, `k_text`, `doc_id`, `fp` (the 64 bits as a long) for every row of `docs`."""
    def scan(batch):
        found = np.fromiter((fingerprint(t, shingle) for t in raw(batch.column(3))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], signed(found)], ["k_id", "k_text", "doc_id", "fp"])

    return over_texts(keyed(docs, id_col, text_col), scan, "k_id long, k_text long, doc_id long, fp long")


def distance(x: np.ndarray, y, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ y) & mask).astype(np.int16)


def cut(points: np.ndarray, mask: np.uint64):
    """A vantage point and a radius that halve `points`, or None if no radius does.

    Of a few points, the one whose ball splits most evenly is taken.
    """
    best = None
    for i in range(0, len(points), max(1, len(points) // 4)):
        d = distance(points, points[i], mask)
        below = np.cumsum(np.bincount(d, minlength=65))
        gap = np.abs(2 * below - len(points))
        gap[(below == 0) | (below == len(points))] = len(points) + 1
        r = int(np.argmin(gap))
        if gap[r] <= len(points) and (best is None or gap[r] < best[0]):
            best = (gap[r], points[i], r)
    return best and best[1:]


def plant(sample: np.ndarray, mask: np.uint64, leaf: int) -> list[tuple]:
    """A vantage-point tree over `sample` as a list of nodes: (vantage, radius, inner, outer, mask),
    or (None, shard, 0, 0, mask) for a leaf of at most `leaf` sampled points.

    Points that no radius halves by the bits of `mask` are equal there; all their bits tell them apart.
    """
    nodes, shards, todo = [None], 0, [(0, np.unique(sample))]
    while todo:
        at, points = todo.pop()
        if len(points) <= leaf:
            nodes[at] = (None, shards, 0, 0, mask)
            shards += 1
            continue
        split, by = cut(points, mask), mask
        if split is None:
            split, by = cut(points, WHOLE), WHOLE
        near = distance(points, split[0], by) <= split[1]
        nodes[at] = (split[0], split[1], len(nodes), len(nodes) + 1, by)
        nodes += [None, None]
        todo += [(len(nodes) - 2, points[near]), (len(nodes) - 1, points[~near])]
    return nodes


def route(nodes: list[tuple], points: np.ndarray, reach: int, bits: int):
    """Yield (shard, indices at home there, indices visiting).

    A point lives where its distances lead. It also visits a shard if, by the triangle
    inequality, a point within `reach` by the tree's bits and `bits` by all may live there. Of two
    shards that overlap, only the points of the outer one visit, so that each pair meets once.
    """
    todo = [(0, np.arange(len(points)), np.arange(0))]
    while todo:
        at, home, guest = todo.pop()
        if not len(home) and not len(guest):
            continue
        vantage, radius, inner, outer, mask = nodes[at]
        if vantage is None:
            yield radius, home, guest
            continue
        allow = bits if mask == WHOLE else reach
        dh, dg = distance(points[home], vantage, mask), distance(points[guest], vantage, mask)
        todo.append((inner, home[dh <= radius],
                     np.concatenate([guest[dg <= radius + allow], home[(dh > radius) & (dh <= radius + allow)]])))
        todo.append((outer, home[dh > radius], guest[dg > radius - allow]))


class Forest:
    """Union-find over numpy arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                break
            root = up
        self.parent[x] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_shard(home: np.ndarray, guest: np.ndarray, mask: np.uint64, reach: int, bits: int, leaf: int = 64):
    """Indices of points (home first, then guest) that have a link in this shard, and for
    each the least index that its links lead to. A tree over the shard's own points
    prunes branches by the same bounds; what is left is compared bit by bit."""
    points, forest = np.concatenate([home, guest]), Forest(len(home) + len(guest))
    todo = [(np.arange(len(home)), np.arange(len(points)))]
    while todo:
        here, ask = todo.pop()
        if not len(here) or not len(ask):
            continue
        split, within, allow = None, mask, reach
        if len(here) > leaf:
            split = cut(points[here], mask)
            if split is None:  # equal halves: the whole fingerprints still differ
                split, within, allow = cut(points[here], WHOLE), WHOLE, bits
        if split is None:
            for i in range(0, len(ask), 1 << 14):
                block = ask[i:i + (1 << 14)]
                for j in range(0, len(here), leaf):
                    some = here[j:j + leaf]
                    q, h = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[some][None, :]) <= bits)
                    q, h = block[q], some[h]
                    apart = q != h
                    forest.join(q[apart], h[apart])
            continue
        dh, dq = distance(points[here], split[0], within), distance(points[ask], split[0], within)
        todo.append((here[dh <= split[1]], ask[dq <= split[1] + allow]))
        todo.append((here[dh > split[1]], ask[dq > split[1] - allow]))
    root = forest.find(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return linked, root[linked]


def links(distinct: DataFrame, bits: int = 4, shard_rows: int = 20_000, leaf_sample: int = 16,
          max_sample: int = 1 << 22) -> DataFrame:
    """Links `a`, `b` that connect exactly the values of `fp` connected by distances of at
    most `bits` (a spanning set of them, not all pairs).

    Two fingerprints within `bits` are within half of that on their lower or their upper 32
    bits. For each half a vantage-point tree in the Hamming distance of that half deals the
    fingerprints into shards of about `shard_rows`. It is planted on a sample of at most
    `max_sample` fingerprints (chosen by hash, about `leaf_sample` a shard) and decides only
    where points meet. Each shard is searched by itself and yields one row for a linked point.
    """
    n = distinct.count()
    wanted = min(max_sample, max(64, n * leaf_sample // shard_rows))
    share = min((1 << 62) - 1, int((1 << 62) * wanted / max(n, 1)))
    picked = distinct.filter((F.xxhash64("fp").bitwiseAND((1 << 62) - 1)) <= share).select("fp")
    sample = np.sort(np.array([r[0] for r in picked.collect()], np.int64)).view(np.uint64)
    trees = [plant(sample, mask, leaf_sample) for mask in HALVES]
    reach = bits // len(HALVES)

    def deal(batch):
        points = batch.column(0).to_numpy().view(np.uint64)
        for t, nodes in enumerate(trees):
            shard, point, guest = [], [], []
            for s, home, visits in route(nodes, points, reach, bits):
                n_rows = len(home) + len(visits)
                shard.append(np.full(n_rows, 2 * s + t))
                point.append(points[np.concatenate([home, visits])])
                guest.append(np.repeat([False, True], [len(home), len(visits)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shard).astype(np.int64)), signed(np.concatenate(point)),
                 pa.array(np.concatenate(guest))], ["shard", "fp", "guest"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        points, guest = rows["fp"].to_numpy().view(np.uint64), rows["guest"].to_numpy(bool)
        mask = HALVES[int(rows["shard"].iloc[0]) % 2]
        home, guest = np.sort(points[~guest]), np.sort(points[guest])
        linked, root = link_shard(home, guest, mask, reach, bits)
        points = np.concatenate([home, guest]).view(np.int64)
        return pd.DataFrame({"a": points[linked], "b": points[root]})

    dealt = over_texts(distinct.select("fp"), deal, "shard long, fp long, guest boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, shard_rows: int) -> DataFrame:
    """`k_id`, `k_text`, `doc_id`, `fp`, `label` (of the component, never null), `component_id`."""
    fps = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct, bits, shard_rows))
    named = (distinct.join(labels, distinct["fp"] == labels["node"], "left")
             .select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # A component may hold a third of the fingerprints: `keys.attach` lets adaptive execution split it.
    named = keys.attach(named, least, "label", "inner", null_safe=False).select("fp", "label", "component_id")
    return keys.attach(fps, named, "fp", "inner", null_safe=False)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    bits: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id` for each row of `docs`.

    Fingerprints of at most `bits` differing bits are linked; the component is the least id
    reachable. Equal fingerprints are one point of the search, so copies cost nothing there.
    A null text counts as empty; texts without a word have fingerprint zero and are linked
    like any other. Null ids are never a component's id, unless all its ids are null (then
    that is null). Repeated rows are rows like any other; an empty table gives no rows.
    """
    return grouped(docs, id_col, text_col, shingle, bits, shard_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                  bits: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """The rows of `docs`, with their columns, that stay when one of each component does.

    Components are those of `near_duplicates`, so texts without a word (null, empty, blank) are one.
    The row of the least id stays (nulls last); of several rows with that id, the one whose text
    has the least hash; of equal rows, one. An empty table stays empty.
    """
    found = grouped(docs, id_col, text_col, shingle, bits, shard_rows)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "k_id", "k_text")
    stay = (found.groupBy("label").agg(F.min(order).alias("o"))
            .select(F.col("o.k_id").alias("k_id"), F.col("o.k_text").alias("k_text")))
    copies = found.groupBy("k_id", "k_text").agg(F.count(F.lit(1)).alias("n_rows"))
    stay = stay.join(copies, ["k_id", "k_text"])
    return attach(docs, id_col, text_col, stay).select("doc.*")
