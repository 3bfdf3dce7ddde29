"""WARC archives, written and read as a table of payload chunks."""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import keys
from .common import drop_attempts, opened, over_texts, scratch, ship, stored

CHUNK = 1 << 18  # bytes of payload in a row
SPAN = 1 << 25  # bytes of an archive that one row of the manifest covers
BLOCK = 1 << 20  # bytes that are read at once
END = b"\r\n\r\n"


def chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunked record table: `record`, `page_id`, `url`, `chunk`, `last`, `size`, `digest`, `data`.

    Payloads are cut into rows of at most CHUNK bytes; `size` and `digest` (SHA-1) are those of the
    payload up to the end of the row, so the last row of a record has those of the whole.
    """
    def cut(batch):
        rows = []
        held = 0
        for record, page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                              batch.column(3).cast(pa.large_binary())):
            view = memoryview(payload.as_buffer() or b"") if payload.is_valid else memoryview(b"")
            sha, n = hashlib.sha1(), max(1, -(-len(view) // CHUNK))
            for i in range(n):
                data = bytes(view[i * CHUNK:(i + 1) * CHUNK])
                sha.update(data)
                rows.append((record, page, url, i, i == n - 1, min(len(view), (i + 1) * CHUNK), sha.digest(), data))
                held += len(data)
                if held >= 16 * CHUNK:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    types = [("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()),
             ("size", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], [n for n, _ in types])

    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    return over_texts(rows, cut, "record long, page_id long, url string, chunk long, last boolean, size long, digest binary, data binary")


def kinds(table: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`record`, `total`, `sha1`, `refers_to` (null for a response), `response` per record.

    Of payloads with equal digest and length, of `min_bytes` or more, the least page id (null
    last) is the response. The least is an aggregate, joined back so that a common payload can be split.
    """
    records = table.filter("last").select("record", "page_id", F.col("size").alias("total"), F.col("digest").alias("sha1"))
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"))
    least = records.filter(F.col("total") >= min_bytes).groupBy("sha1", "total").agg(F.min(order)["id"].alias("least"), F.count(F.lit(1)).alias("n"))
    least = least.filter("n > 1").select("sha1", "total", "least", F.lit(True).alias("shared"))
    joined = keys.attach(records, least, ["sha1", "total"], null_safe=False)
    response = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("least"))
    return joined.select("record", "total", "sha1", response.alias("response"), F.when(~response, F.col("least")).alias("refers_to"))


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def fields(kind: str, record_id: str, length: int, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *more,
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def head(row: dict) -> bytes:
    """All of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['total']}\r\n\r\n".encode()
    uri = quote(row["url"] or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")
    more = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest_text(row['sha1'])}")]
    name = f"{page_urn(row['page_id'])}:{row['record']}"
    if row["response"]:
        return fields("response", name, len(http) + row["total"], *more) + http
    more += [("WARC-Refers-To", f"<{page_urn(row['refers_to'])}>"),
             ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return fields("revisit", name, len(http), *more) + http


def write(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, **names) -> None:
    """Write a record per page into `folder`, one gzip member each, in one archive per task.

    Chunk rows of a record follow each other, and go one by one through the compressor, so
    no task holds a whole payload. A task writes under a name of its own attempt and renames
    the finished archive. `manifest` beside the archives lists runs of whole records.
    """
    spark = pages.sparkSession
    ship(spark)
    table = stored(chunks(pages, **names), "chunks")
    rows = (table.repartition("record").join(kinds(table, min_bytes), "record")
            .filter("response or chunk = 0").sortWithinPartitions("record", "chunk")
            .select("record", "page_id", "url", "chunk", "last", "total", "sha1", "response", "refers_to",
                    F.when(F.col("response"), F.col("data")).alias("data")))

    def run(batches):
        part, system, base = TaskContext.get().partitionId(), *opened(folder)
        attempt, name = f"{base}/_attempts/{TaskContext.get().taskAttemptId()}", f"part-{part:08d}.warc.gz"
        out, at, start, member, spans = None, 0, 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(f"{base}/_attempts")
                    out = system.open_output_stream(attempt)
                if row["chunk"] == 0:
                    member = zlib.compressobj(level, wbits=31)
                    at += out.write(member.compress(head(row)))
                if row["data"]:
                    at += out.write(member.compress(row["data"]))
                if row["last"] or not row["response"]:
                    at += out.write(member.compress(END) + member.flush())
                    if at - start >= SPAN:
                        spans.append((name, start, at - start))
                        start = at
        if out is not None:
            if at > start:
                spans.append((name, start, at - start))
            out.close()
            system.move(attempt, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*spans)], ["file", "start", "length"])

    rows.mapInArrow(run, "file string, start long, length long").write.parquet(f"{folder}/manifest")
    drop_attempts(folder)


def members(file, start: int, length: int):
    """Yield, for each gzip member of a span, an iterator over its decompressed blocks."""
    file.seek(start)
    left, rest = length, b""

    def blocks(unzip):
        nonlocal left, rest
        while not unzip.eof:
            if not rest:
                rest = file.read(min(BLOCK, left))
                left -= len(rest)
                if not rest:
                    raise ValueError("archive ends within a record")
            data, todo = b"", rest
            data = unzip.decompress(todo, BLOCK)
            rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            yield data

    while left or rest:
        yield blocks(zlib.decompressobj(wbits=31))


def parse(blocks) -> tuple:
    """(page id, payload bytes, digest, kind, refers to) of a record, its payload streamed
    through the digest; a response's digest must be the one that its header states."""
    buffer = b""
    while buffer.count(END) < 2:
        buffer += next(blocks)
    warc, http, rest = buffer.split(END, 2)
    names = dict(line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    stated, kind = names["WARC-Payload-Digest"].removeprefix("sha1:"), names["WARC-Type"]
    page = names["WARC-Record-ID"].split(":")[2]
    refers = names.get("WARC-Refers-To", "<urn:page:null>")[1:-1].split(":")[2]
    if kind == "response":
        sha, left = hashlib.sha1(), size
        while True:
            sha.update(rest[:left])
            left -= len(rest[:left])
            rest = next(blocks, None)
            if rest is None:
                break
        if left or digest_text(sha.digest()) != stated:
            raise ValueError(f"payload of {names['WARC-Record-ID']} is damaged")
    else:
        for _ in blocks:
            pass
    return (None if page == "null" else int(page), size, stated, kind, None if refers == "null" else int(refers))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """`page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` per record of the archives."""
    ship(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batch):
        system, base = opened(folder)
        for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length"))):
            with system.open_input_file(f"{base}/{name}") as file:
                found = []
                for blocks in members(file, start, length):
                    found.append(parse(blocks))
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    spans = spark.read.parquet(f"{folder}/manifest")
    return over_texts(spans.repartition(max(1, spans.count()), "file", "start"), run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, **names) -> DataFrame:
    """Write `pages` as archives and read them back.

    A null payload is empty, a null url is written as `urn:none`. A null page id is last in order
    and read back as null. Repeated rows of the least id are all responses.
    """
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder, min_bytes, **names)
    return read(pages.sparkSession, folder)
