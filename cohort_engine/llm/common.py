"""What several operators share: scratch storage, row keys, words and their hashes."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

NULL_ID = -(1 << 63)
PIECE = 1 << 22  # bytes of a text that are split into words at once
ODD = np.uint64(0x9E3779B97F4A7C15)  # base of the rolling hashes
ODD_2 = np.uint64(0xD6E8FEB86659FD93)


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds what operators store in this Spark application."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the run's folder."""
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


def close_run(spark: SparkSession) -> None:
    """Remove what operators have stored in this application. Frames that they returned read it, so
    first store what is wanted of them elsewhere."""
    system, folder = opened(run_folder(spark))
    if system.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(folder)


def drop_attempts(folder: str) -> None:
    """Remove what failed attempts of tasks left beside the files of `folder`."""
    system, base = opened(folder)
    if system.get_file_info(f"{base}/_attempts").type == pyarrow.fs.FileType.Directory:
        system.delete_dir(f"{base}/_attempts")


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder that is given as a path or a URI."""
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for a Spark application, so that
    their Python workers can import them wherever the driver found them."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    name = f"{package.name}-{context.applicationId}.zip"
    if any(name in x for x in context._python_includes):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    system, folder = opened(shared_folder(spark))
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/{name}") as out:
        out.write(packed.getvalue())
    uri = shared_folder(spark)
    context.addPyFile(f"{uri}/{name}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, drop_shuffles: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again. With `drop_shuffles`, the shuffle files of
    that job go when it ends, and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    folder, before = scratch(spark, what), spark.conf.get(SHUFFLE_CLEANUP, "false")
    if drop_shuffles:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        if drop_shuffles:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`k_id`, `k_text`: never null, equal for rows of equal id and text; `doc_id`, `text`.

    Other columns of `df` are left out, so none can clash.
    """
    return df.select(key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text"),
                     F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def key_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def key_text(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(text_col).cast("string"))


def raw(column: pa.Array) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    return (x or b"" for x in column.cast(pa.large_binary()).to_pylist())


def pieces(text: bytes) -> Iterator[bytes]:
    """`text` cut at white space into parts of about PIECE bytes."""
    start, end = 0, len(text)
    while end - start > PIECE:
        cut = start + PIECE
        while cut < end and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word; words are split at ASCII white space."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
             for words in map(bytes.split, pieces(text))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a uint64 array."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A Karp-Rabin hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= ODD
        out += words[j:n + j]
    return mixed(out)


class Ranges:
    """Rolling hashes of any ranges of one sequence of word hashes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: np.uint64 = ODD):
        power, self.inverse = self.powers(int(base), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[:len(words)], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(base)
        if known is None or len(known[0]) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            known = (both[0], both[1])
            if size <= 1 << 20:  # longer tables are made anew for the rare text that needs them
                cls._powers[base] = known
        return known

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(value + (end - start).astype(np.uint64) * ODD_2)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def over_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `fn` to every Arrow batch of `df`."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def spread(keys: dict[str, np.ndarray | list], counts: list[int]) -> dict[str, pa.Array]:
    """Repeat per-document values for the rows that each document yields."""
    return {name: pa.array(np.repeat(np.asarray(values, np.int64), counts)) for name, values in keys.items()}


def attach(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """One row of `docs`, packed as `doc`, for each row of `found` (`k_id`, `k_text`, `n_rows`
    and more), which has one row per key; `n_rows` says how many rows of `docs` have the key.

    Keys of a single row are joined as they are; only repeated rows are reduced to one first.
    """
    packed = docs.select(F.struct("*").alias("doc"), key_id(id_col).alias("k_id"), key_text(id_col, text_col).alias("k_text"))
    joined = packed.join(found, ["k_id", "k_text"])
    return joined.filter("n_rows = 1").unionByName(joined.filter("n_rows > 1").dropDuplicates(["k_id", "k_text"]))
