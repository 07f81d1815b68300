"""WARC archives with a two-level capture index.

Pages become gzip-membered WARC records, one archive file a task. The captures, sorted by
reversed-host URL key, are written as index parts: compressed blocks of lines, then a
sparse directory (each block's first key, offset and length) and its place. A look-up
searches the parts' first keys, the part's directory and the block, each by bisection,
before it reads the record's bytes from the archive.

All files stand in the folder given, which driver and executors share. A task writes files
of its own name; only those of tasks that came to their end are in the tables of captures
and parts, so a task that is run again leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import map_slices, materialise, scratch, slices, table

#: Lines of an index block, and the gap in bytes over which two records are read at once.
BLOCK_LINES, READ_GAP, READ_MOST = 1000, 64 << 10, 4 << 20
#: Bytes of records that one reading task takes, about.
TASK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- files --------------------------------------------------------------------------------

def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    local = path.removeprefix("file:")
    return pafs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else os.path.abspath(local)


class _Writer:
    """A file whose members' places are known."""

    def __init__(self, folder: str, suffix: str):
        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, at = _open(self.path)
        system.create_dir(os.path.dirname(at), recursive=True)
        self.out, self.size = system.open_output_stream(at, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)


class _Reader:
    """Range reads from one file at a time."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            system, at = _open(path)
            self.path, self.file = path, system.open_input_file(at)
        return self.file.read_at(length, offset)

    def size(self, path: str) -> int:
        self.read(path, 0, 0)
        return self.file.size()

    def close(self):
        if self.file:
            self.file.close()
        self.path = self.file = None


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# --- keys and records ---------------------------------------------------------------------

def _plain(text: str) -> str:
    """ASCII without spaces or control characters; others as percent escapes of their UTF-8 bytes."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in text.encode())


def url_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL; an empty key for null; what can't be split stays as it is."""
    if not url:
        return ""
    try:
        x = urlsplit(url.strip())
        host, port = x.hostname, x.port
    except ValueError:
        return _plain(url)
    if not host:
        return _plain(url)
    port = f":{port}" if port and (x.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return _plain(",".join(reversed(host.split("."))) + port + ")" + (x.path or "/") + (f"?{x.query}" if x.query else ""))


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """An uncompressed WARC record; a revisit keeps the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_plain(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}"]
    head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT}"] if revisit else []
    block += b"" if revisit else payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs if k}


def parse_record(data: bytes) -> dict:
    """One gzip member or plain record -> its fields; a payload that its digest contradicts is an error."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
    if not revisit and b32_sha1(payload) != digest:
        raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
    size = int(_headers(http)["content-length"]) if revisit else len(payload)
    return {"page_id": _page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": _page_of(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload}


# --- writing ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Archive:
    folder: str
    #: Captures as Parquet, not in order: key, page_id, file, offset, length.
    captures: DataFrame
    #: One row an index part: part, file, first_key, last_key, blocks, lines.
    parts: DataFrame
    #: Of all records as written.
    size: int


CAPTURE = "key string, page_id long, file string, offset long, length long"
PART = "part long, file string, first_key string, last_key string, blocks long, lines long"


def write_archive(df: DataFrame, page_id: str, url: str, html: str, folder: str | None = None, min_bytes: int = 0) -> Archive:
    """Writes a record for each row of df and the index over them.

    Null html: an empty payload. Of rows with equal payloads of min_bytes at least, that
    with the smallest page_id is the response and the others revisit it; rows that share
    this page_id are all responses. A null page_id counts as the largest; where a group
    has no other, all its rows are responses. Null or odd URLs get a key too. Other
    columns are not looked at. An empty table gives an archive without files.
    """
    folder = folder or scratch(df.sparkSession, "archive")
    pages = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "utf-8").alias("payload"))
    pages = pages.withColumn("sum", F.sha1("payload"))
    # only payloads that come twice; a hot one is one row here, and the join's other side can be split
    firsts = pages.where(F.length("payload") >= min_bytes).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("sum").alias("first_sum"), "first")
    marked = pages.join(firsts, (F.col("sum") == F.col("first_sum")), "left").select("page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches):
        out = None
        for batch in batches:
            for part in slices(batch, "payload"):
                rows = {k: [] for k in ("key", "page_id", "file", "offset", "length")}
                for p, u, data, first, again in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out = out or _Writer(f"{folder}/warc", ".warc.gz")
                    at, n = out.add(gzip_member(record(p, u, data, first if again else None, again)))
                    for k, v in zip(rows, (url_key(u), p, out.path, at, n), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out:
            out.out.close()

    captures = materialise(marked.mapInArrow(write, CAPTURE), "captures")
    ranged = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def index(batches):
        out, lines, directory, last = None, [], [], ""
        count = 0

        def flush():
            nonlocal count
            data = gzip_member("\n".join("\t".join(x) for x in lines).encode())
            directory.append((lines[0][0], *out.add(data)))
            count += len(lines)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _Writer(f"{folder}/index", ".idx")
                lines.append(tuple("" if v is None else str(v) for v in row))
                last = lines[-1][0]
                if len(lines) == BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            at, n = out.add(gzip_member(json.dumps(directory).encode()))
            out.add(at.to_bytes(8, "little") + n.to_bytes(8, "little"))
            out.out.close()
            yield pa.RecordBatch.from_pydict({"file": [out.path], "first_key": [directory[0][0]], "last_key": [last], "blocks": [len(directory)], "lines": [count]})

    parts = materialise(ranged.mapInArrow(index, PART.removeprefix("part long, ")), "parts")
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return Archive(folder, captures, parts.withColumn("part", F.monotonically_increasing_id()), size)


# --- reading ------------------------------------------------------------------------------

def block_directory(reader: _Reader, file: str) -> list[tuple[str, int, int]]:
    size = reader.size(file)
    tail = reader.read(file, size - 16, 16)
    at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
    return [tuple(x) for x in json.loads(zlib.decompress(reader.read(file, at, n), 31))]


class IndexPart:
    """Bisection in one part: its directory first, then in a block that is kept for the next key."""

    def __init__(self, file: str):
        self.file, self.reader = file, _Reader()
        self.directory = block_directory(self.reader, file)
        self.firsts = [x[0] for x in self.directory]
        self.block = lru_cache(maxsize=2)(self._block)

    def _block(self, i: int) -> tuple[list[str], list[list[str]]]:
        _, at, n = self.directory[i]
        lines = [x.split("\t") for x in zlib.decompress(self.reader.read(self.file, at, n), 31).decode().split("\n")]
        return [x[0] for x in lines], lines

    def find(self, key: str):
        """The captures of key in this part, in order."""
        # a key's captures may begin in the block before the first that starts with it
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            keys, lines = self.block(i)
            for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                yield line


def lookup(archive: Archive, keys: DataFrame, key: str = "key") -> DataFrame:
    """The captures of all keys: key, page_id, file, offset, length. Repeated keys count once; null ones are empty keys.

    The parts' first and last keys go to every task: one row an index part, that is a
    range partition, however large the archive. A key that goes over several parts is
    looked up in each, so a hot key's captures are read by several tasks.
    """
    parts = sorted(tuple(r) for r in archive.parts.select("first_key", "last_key", "file").collect())
    starts, ends = [p[0] for p in parts], [p[1] for p in parts]

    def place(batches):
        for batch in batches:
            rows = [(k, i) for k in batch.column(0).to_pylist() for i in range(bisect_left(ends, k), bisect_right(starts, k))]
            yield pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "part": [r[1] for r in rows]}, schema=pa.schema([("key", pa.string()), ("part", pa.int64())]))

    def find(batches):
        at, part = None, None
        for batch in batches:
            rows = []
            for k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != at:
                    at, part = i, IndexPart(parts[i][2])
                rows += part.find(k)
                if len(rows) >= 20_000:
                    yield _captures(rows)
                    rows = []
            yield _captures(rows)

    wanted = keys.select(F.coalesce(F.col(f"`{key}`"), F.lit("")).alias("key")).distinct()
    placed = wanted.mapInArrow(place, "key string, part long")
    # equal ranges of (part, key): a part of many keys is shared out
    return placed.repartitionByRange("part", "key").sortWithinPartitions("part", "key").mapInArrow(find, CAPTURE)


def _captures(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "key": pa.array([r[0] for r in rows], pa.string()), "page_id": pa.array([int(r[1]) if r[1] else None for r in rows], pa.int64()),
        "file": pa.array([r[2] for r in rows], pa.string()), "offset": pa.array([int(r[3]) for r in rows], pa.int64()), "length": pa.array([int(r[4]) for r in rows], pa.int64()),
    })


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_tasks(archive: Archive) -> int:
    """Tasks that a whole archive is read by: the rows dealt are light, so their bytes don't tell."""
    cores = archive.captures.sparkSession.sparkContext.defaultParallelism
    return max(1, min(archive.size // TASK_BYTES, max(4 * cores, archive.size // (16 * TASK_BYTES))))


def read_records(captures: DataFrame, tasks: int) -> DataFrame:
    """The records that captures point to, read by ranges; neighbours in a file are read at once."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        reader, held = _Reader(), []

        def run():
            file, first, end = held[0][0], held[0][1], max(o + n for _, o, n in held)
            data = memoryview(reader.read(file, first, end - first))
            rows = [parse_record(bytes(data[o - first : o - first + n])) for _, o, n in held]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (f != held[0][0] or o - held[-1][1] - held[-1][2] > READ_GAP or o + n - held[0][1] > READ_MOST):
                    yield run()
                held.append((f, o, n))
        if held:
            yield run()
        reader.close()

    return captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def with_key(df: DataFrame, url: str, keep: list[str] | None = None) -> DataFrame:
    """Adds key, the reversed-host key of a URL column."""
    return map_slices(df, url, [T.StructField("key", T.StringType())], lambda: lambda a: [[url_key(u) for u in a.to_pylist()]], keep)


def op4(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write_archive(pages, "page_id", "url", "html")
    out = read_records(lookup(archive, with_key(pages.select("url"), "url", [])), read_tasks(archive))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS h FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
