"""Token ids in files of independent zstandard frames that readers can seek in."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import drop_attempts, keyed, opened, pieces, raw, scratch, ship

# Fixed values of the public seekable zstandard format.
SKIPPABLE, SEEKABLE, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 20  # a frame is closed when it holds as much
CACHE_WORDS = 700_000  # words whose ids a worker keeps
GROUP = 1 << 20  # bytes of texts whose new words are learned together

PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3])  # what UTF-8 has for such texts only
MARKS = "!-/:-@\\[-`{-~\u00d7\u00f7"
KINDS = bytes(46 if chr(i) in ".," else 33 if re.match(f"[{MARKS}]", chr(i)) or i in (0x97, 0xB7) else i for i in range(256))
LETTERS = re.compile(f"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([{MARKS}]*)")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts through a cache of words.

    The tokenizer lower-cases, drops white space, and cuts texts into runs of letters, single digits
    and runs of other marks, which it encodes apart. So a text's ids are those of its parts, cut
    at white space, one after the other, and a part may be cut again where such a run begins. Texts
    of ASCII and Latin letters are lower-cased as a whole and cut before each full stop and comma
    too, if no mark stands before one of them and no special token can be meant; any other text is cut at
    ASCII white space. A worker keeps the ids of parts it has met. New parts of many texts are
    learned together: runs of letters in one call, their ids told apart by the tokens that end a
    run, and all other parts in another.
    """

    END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None  # for runs of letters that are in lower case already
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(self.END)]] = True
        self.cache: dict[str | bytes, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, parts: set[str | bytes]) -> None:
        split, rest, runs = {}, [], []  # split: letters with marks behind, as run and marks
        for p in parts:
            if p.isalpha() and isinstance(p, str):
                runs.append(p)
            elif m := LETTERS.fullmatch(p if isinstance(p, str) else p.decode()):
                split[p] = m[1].lower(), m[2]
            else:
                rest.append(p)
        runs += {run for run, _ in split.values()}.difference(self.cache, runs)
        if runs:
            ids = np.array(self.letters.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(runs) or cuts[-1] != 4 * len(ids):
                raise ValueError("the tokenizer does not encode words apart from each other")
            flat = ids.tobytes()
            self.cache.update(zip(runs, map(flat.__getitem__, map(slice, [0, *cuts], cuts))))
        rest += {marks for _, marks in split.values()}.difference(self.cache, rest)
        for p, found in zip(rest, self.tokenizer.encode_batch_fast([p if isinstance(p, str) else p.decode() for p in rest], add_special_tokens=False)):
            self.cache[p] = np.array(found.ids, np.uint32).tobytes()
        for p, (run, marks) in split.items():
            self.cache[p] = self.cache[run] + self.cache[marks]

    def parts(self, text: bytes) -> list[str] | list[bytes]:
        if text.translate(None, PLAIN) or b"<|" in text or b"!." in (kinds := text.translate(KINDS)) or b".." in kinds:
            return text.split()
        return text.decode().lower().replace(".", " .").replace(",", " ,").split()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        done, new = [], set()
        for text in texts:
            for i, piece in enumerate(pieces(text)):
                parts = self.parts(piece)
                got = list(map(self.cache.get, parts))
                unknown = [k for k, ids in enumerate(got) if ids is None]
                new.update(map(parts.__getitem__, unknown))
                done.append((i, parts, got, unknown))
        self.learn(new)
        out = []
        for i, parts, got, unknown in done:
            for k in unknown:
                got[k] = self.cache[parts[k]]
            ids = b"".join(got)
            if i:
                out[-1] += ids
            else:
                out.append(ids)
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def grouped(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of at least GROUP bytes but for the last."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= GROUP:
            yield some
            some, size = [], 0
    if some:
        yield some


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes frames to an open stream, and at its end their sizes and checksums."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames, self.held, self.size = [], [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Put `data` into the open frame; its frame number and place there."""
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            packed = self.zstd.compress(data)
            self.stream.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class FrameReader:
    """Decompresses single frames of a file, by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flag != CHECKSUM_FLAG:
            raise ValueError("not a file of seekable frames with checksums")
        file.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])

    def frame(self, i: int) -> bytes:
        packed, size, check = self.frames[i].tolist()
        self.file.seek(int(self.starts[i]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` into files of `folder`, in ascending order of id (null last, then by text key).

    Files are numbered by ranges of ids, one for a task. A task writes under a name of its
    own attempt and renames the finished file, so that lost and repeated tasks leave one whole
    file. The folder `index` beside the files tells of each document its file, frame, place and length.
    """
    ship(docs.sparkSession)

    def run(batches):
        part, system, base = TaskContext.get().partitionId(), *opened(folder)
        attempt = f"{base}/_attempts/{TaskContext.get().taskAttemptId()}"
        name, writer, before = f"part-{part:08d}.zst", None, 0
        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for ids in chain.from_iterable(map(words.encode_all, grouped(raw(batch.column("text"))))):
                if writer is None:
                    system.create_dir(f"{base}/_attempts")
                    writer = FrameWriter(system.open_output_stream(attempt))
                ids = ids + end
                frame, place = writer.add(ids)
                rows.append((part, frame, place // 4, len(ids) // 4, before))
                before += len(ids) // 4
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                    ["doc_id", "part", "frame", "place", "n_tokens", "before"])
        if writer is not None:
            writer.close()
            system.move(attempt, f"{base}/{name}")

    order = [F.col("doc_id").isNull(), F.col("k_id"), F.col("k_text")]
    rows = keyed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.mapInArrow(run, "doc_id long, part long, frame long, place long, n_tokens long, before long")
     .write.parquet(f"{folder}/index"))
    drop_attempts(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before), `n_tokens`, `part`, `frame`, `place` per document."""
    rows = spark.read.parquet(f"{folder}/index")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    parts = (rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")))
    return rows.join(parts, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens",
                                           "part", "frame", "place")


def read(folder: str, wanted: DataFrame) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids` (little-endian unsigned 32-bit) of the rows of `index` in
    `wanted`. Only frames that hold one of them are read; each is checked against its checksum."""
    ship(wanted.sparkSession)

    def run(batches):
        system, base = opened(folder)
        reader = data = None
        at = (None, None)
        for batch in batches:
            out = []
            for part, frame, place, n in zip(*(batch.column(c).to_pylist() for c in ("part", "frame", "place", "n_tokens"))):
                if part != at[0]:
                    reader = FrameReader(system.open_input_file(f"{base}/part-{part:08d}.zst"))
                if (part, frame) != at:
                    at, data = (part, frame), reader.frame(frame)
                out.append(data[4 * place:4 * (place + n)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")),
                                              pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    spread_out = max(1, wanted.select("part").distinct().count())
    rows = wanted.repartition(spread_out, "part", "frame").sortWithinPartitions("part", "frame", "place")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` of all documents, from files just written.

    A null text counts as empty and has the end id only. Repeated rows are written one after
    the other. An empty table writes no file and gives no rows.
    """
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, end_id, id_col, text_col)
    return read(folder, index(docs.sparkSession, folder)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
