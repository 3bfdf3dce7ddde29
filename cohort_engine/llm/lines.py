"""Repeated runs of lines: windows of three consecutive lines, found over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import keys
from .common import NULL_ID, ODD, ODD_2, keyed, mixed, over_texts, raw, signed, spread, stored


def content_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines of a text, and the places of those that hold a word."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line and not line.isspace()]


def windows(docs: DataFrame, size: int) -> DataFrame:
    """`h1`, `h2`, `k_id`, `k_text`, `pos`: hashes of each run of `size` lines that hold a word."""
    def scan(batch):
        out = []
        for t in raw(batch.column(3)):
            lines, places = content_lines(t)
            n = len(places) - size + 1
            if n <= 0:
                out.append((np.empty(0, np.uint64),) * 2)
                continue
            one = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in places), np.uint64, len(places))
            two = np.fromiter((xxhash.xxh64_intdigest(lines[i]) for i in places), np.uint64, len(places))
            h1, h2 = one[:n].copy(), two[:n].copy()
            for j in range(1, size):
                h1 = h1 * ODD + one[j:n + j]
                h2 = h2 * ODD_2 + two[j:n + j]
            out.append((mixed(h1), mixed(h2)))
        counts = [len(o[0]) for o in out]
        keys = spread({"k_id": batch.column(0).to_numpy(), "k_text": batch.column(1).to_numpy()}, counts)
        pos = np.concatenate([np.arange(c) for c in counts])
        h1, h2 = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([signed(h1), signed(h2), *keys.values(), pa.array(pos)],
                                         ["h1", "h2", "k_id", "k_text", "pos"])

    return over_texts(docs, scan, "h1 long, h2 long, k_id long, k_text long, pos long")


def later_windows(docs: DataFrame, size: int) -> DataFrame:
    """`k_id`, `k_text`, `places`: of each text, the windows that occurred before.

    Occurrences are ordered by id (null last), text key and place. The least one per
    window is an aggregate with a map-side step; it is joined back to the windows, and the rows
    of a common window can be split there.
    """
    place = F.struct((F.col("k_id") == F.lit(NULL_ID)).alias("n"), "k_id", "k_text", "pos")
    found = stored(windows(docs, size), "windows")
    first = (found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter("first <> last").select("h1", "h2", "first"))
    later = keys.attach(found, first, ["h1", "h2"], "inner", null_safe=False).filter(place != F.col("first"))
    return later.groupBy("k_id", "k_text").agg(F.collect_set("pos").alias("places"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """`doc_id`, `n_lines`, `n_removed`, `kept` (the text without the removed lines).

    Windows are `size` consecutive lines that hold a word; lines without one are passed over
    and stay. All occurrences of a window but the first are removed; covered lines of
    overlapping windows are merged. Lines are compared as they stand. Texts of fewer than
    `size` such lines have no window. Null counts as empty. Rows equal in id and text are
    one document given twice and get the same answer. Whole texts are read, other columns are not;
    an empty table gives no rows. Equality is that of 128 bits of hashes.
    """
    texts = keyed(docs, id_col, text_col)

    def apply(batch):
        out = []
        for t, places in zip(raw(batch.column("text")), batch.column("places").to_pylist()):
            if not places:
                out.append((len(content_lines(t)[1]), 0, t.decode()))
                continue
            lines, content = content_lines(t)
            gone = {content[p + j] for p in places for j in range(size)}
            out.append((len(content), len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()))
        n, gone, kept = zip(*out)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])

    joined = texts.join(later_windows(texts, size), ["k_id", "k_text"], "left").select("doc_id", "text", "places")
    return over_texts(joined, apply, "doc_id long, n_lines long, n_removed long, kept string")
