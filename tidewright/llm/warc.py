"""WARC archives written from pages and read back as a table of chunks.

The writer appends a payload chunk after chunk, views of the row that the page comes in, so nothing is copied whole; the reader
streams each archive and yields a row for each (record, chunk number), of bounded size, with the bytes so far and the digest so far, so no
whole record is held there. Each record is a gzip member of its own. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
smallest id is a ``response`` and the others are ``revisit`` records that name it.

Archives lie in the shared folder, under names that no other attempt uses; the writer returns the names of those that it
finished, and only these are read, so a repeated task does no harm.

Defined cases: a null payload is empty; a null id is written as ``null`` and read back as null, and never stands for
others; rows that repeat the smallest id and its payload are all responses; a null URL is written as empty; an empty
table writes nothing and reads as no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidewright.llm.common import map_arrow, materialize, scratch_path

#: Payload bytes in a chunk row; bytes after which a task begins another archive.
CHUNK_BYTES, ARCHIVE_BYTES = 1 << 16, 1 << 27
#: Shorter payloads are never revisits.
REVISIT_BYTES = 100
#: Digests that occur again are broadcast up to this many (some 100 bytes each); beyond, the join shuffles.
BROADCAST_DIGESTS = 200_000
#: Bytes that the reader takes from a file at a time.
READ_BYTES = 1 << 18
#: Tasks that read at most; beyond, a task reads several archives.
MOST_READERS = 20_000

CHUNKS = (
    "page_id bigint, record_type string, refers_to bigint, chunk int, chunk_bytes bigint, bytes_so_far bigint, "
    "digest_so_far string, last boolean, stated_bytes bigint, stated_digest string, data binary"
)


def _file_system(uri: str):
    """PyArrow's file system for a URI, and the path in it: local, HDFS, S3 and whatever else PyArrow opens."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def record_types(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """``page_id, url, body, payload_bytes, payload_digest, refers_to`` (null for responses).

    Only digests that occur again meet in a join, and they are combined before the shuffle, so a payload that a third of
    all pages share is one row for each task.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"),
    )
    again = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("payload_digest", "first_id")
    )
    again = materialize(again, "warc-digests")
    side = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    joined = rows.join(side, "payload_digest", "left")
    differs = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(differs, F.col("first_id"))).drop("first_id")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunk after chunk of each record of the batches. Chunks are views of the batch; no payload is copied whole."""
    for batch in batches:
        facts = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "payload_digest", "refers_to")), strict=True)
        for fact, body in zip(facts, batch.column("body"), strict=True):
            whole = memoryview(body.as_buffer()) if fact[4] is None else b""
            parts = max(1, -(-len(whole) // CHUNK_BYTES))
            for k in range(parts):
                yield *fact, parts, k, whole[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES]


def _with_bytes(records: DataFrame) -> DataFrame:
    return records.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", F.col("body").cast("binary").alias("body"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def _head(page_id: int | None, url: str, size: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    out, name, written, records, done = None, "", 0, 0, []
    running = gz = None
    for page_id, url, size, digest, refers_to, parts, chunk, data in _chunks(batches):
        if chunk == 0:
            if out is None:
                name, written, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            gz, running = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
            written += out.write(gz.compress(_head(page_id, url, size, digest, refers_to)))
        running.update(data)
        written += out.write(gz.compress(data))
        if chunk == parts - 1:
            if refers_to is None and running.hexdigest() != digest:
                raise ValueError(f"page {page_id}: its chunks don't have the digest of its payload")
            written += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            records += 1
            if written >= ARCHIVE_BYTES:
                out.close()
                done.append((name, records, written))
                out = None
    if out is not None:
        out.close()
        done.append((name, records, written))
    names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
    yield pa.record_batch(
        [pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
        names=["archive", "records", "archive_bytes"],
    )


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages; returns the finished archives: ``archive, records, archive_bytes``."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = _with_bytes(record_types(pages, key, html, url))
    return materialize(map_arrow(records, partial(_write, folder=folder), "archive string, records bigint, archive_bytes bigint"), "warc-archives")


class _Stream:
    """The decompressed bytes of an archive, a block at a time."""

    def __init__(self, source) -> None:
        self.source, self.packed, self.plain = source, b"", b""
        self.gz = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                self.packed, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            elif self.gz.unconsumed_tail:
                self.packed = self.gz.unconsumed_tail
            if not self.packed:
                self.packed = self.source.read(READ_BYTES)
                if not self.packed:
                    return False
            data = self.gz.decompress(self.packed, READ_BYTES)
            self.packed = b""
            if data:
                self.plain += data
                return True
            if not self.gz.eof and not self.gz.unconsumed_tail:
                continue

    def head(self) -> dict[str, str] | None:
        """Header lines up to the empty one, by lower-case name; the first line under an empty name."""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.plain.strip():
                    raise ValueError("an archive ends within a header")
                return None
        lines = self.plain[:end].decode().split("\r\n")
        self.plain = self.plain[end + 4 :]
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        while len(self.plain) < most and self.more():
            pass
        if most and not self.plain:
            raise ValueError("an archive ends within a record")
        data, self.plain = self.plain[:most], self.plain[most:]
        return data


def _records(stream: _Stream) -> Iterator[tuple]:
    while (warc := stream.head()) is not None:
        if not warc[""].startswith("WARC/"):
            raise ValueError("no WARC record where one must begin")
        before = len(stream.plain)
        http, size = stream.head() or {}, int(warc["content-length"])
        revisit = warc["warc-type"] == "revisit"
        stated = int(http["content-length"])
        left = 0 if revisit else stated
        page_id, refers_to = _id_of(warc["warc-record-id"]), _id_of(warc["warc-refers-to"]) if revisit else None
        digest, so_far, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.take(min(left, CHUNK_BYTES)) if left else b""
            digest.update(data)
            so_far, left = so_far + len(data), left - len(data)
            yield (
                page_id, warc["warc-type"], refers_to, chunk, len(data), so_far, digest.hexdigest(), not left,
                stated, warc["warc-payload-digest"].removeprefix("sha256:"), data,
            )
            chunk += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n" or size < so_far or before < 0:
            raise ValueError("a record doesn't end where its length says")


def _read(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in CHUNKS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        if not with_data:
            columns[-1] = [None] * len(rows)
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    for batch in batches:
        for archive in batch.column(0).to_pylist():
            fs, path = _file_system(archive)
            rows: list[tuple] = []
            with fs.open_input_stream(path, compression=None) as source:
                for row in _records(_Stream(source)):
                    rows.append(row if with_data else (*row[:-1], None))
                    if len(rows) >= (64 if with_data else 2048):
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)


def read_archives(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of archives (column ``archive``): a row for each chunk of each record.

    Archives are dealt out by ranges of their names, a task for each of them up to ``MOST_READERS`` tasks. The reader recomputes
    digests; at a record's last chunk ``digest_so_far`` is that of the whole payload.
    """
    tasks = max(1, min(archives.count(), MOST_READERS))
    return map_arrow(archives.select("archive").repartitionByRange(tasks, "archive"), partial(_read, with_data=with_data), CHUNKS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, read the archives back: ``key, payload_bytes, payload_digest, record_type, refers_to``.

    Of responses, size and digest are recomputed from what was read; revisits state those of the full payload.
    """
    last = read_archives(write_archives(pages, key, url, html), with_data=False).where("last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("page_id").alias(key),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
