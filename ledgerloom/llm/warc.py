"""Web archives written and read as a table of record chunks.

A payload becomes rows (record, chunk number, data) of at most ``chunk`` bytes, made by the JVM from the
binary column.  The writer takes the rows in order and streams them into a gzip member a record; the reader
streams archives back into the same rows.  Both carry the digest of the payload so far from chunk to chunk,
so no task ever holds more of a record than a chunk, and the last row of a record has its whole digest.

Records with equal payloads are stored once: the one with the smallest ``page_id`` is the response and the
others are revisits of it, which hold the length and digest of the payload but not the payload.

Defined results: a null payload is empty; rows that repeat both page id and payload are all kept and are all
of one type; a null page id is never the smallest unless its group has no other; a null address is replaced
by one made from the page id; an empty table gives no archive and no row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Writer, fresh_folder, reader
from .ship import session_of

CHUNK = 256 * 1024
ARCHIVE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"


def base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def record_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, sha, n_bytes, refers_to, first, chunk_no, last, data), a record's rows in order."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"))
    rows = rows.select("page_id", "url", "body", F.sha1("body").alias("sha"), F.octet_length("body").cast("long").alias("n_bytes"))
    keys = rows.select("page_id", "sha", "n_bytes")
    # Grouped by more than the join's key, so that the join has an exchange on both sides and a digest that
    # many pages share can be split.
    first = keys.groupBy("sha", "n_bytes").agg(F.min("page_id").alias("first")).select("sha", "first")
    decided = keys.select("page_id", "sha").join(first, "sha").groupBy("page_id", "sha").agg(F.first("first").alias("first"))
    decided = decided.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first")
    joined = rows.join(decided, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    stored = F.col("page_id").eqNullSafe(F.col("first"))
    pieces = F.when(stored, F.greatest(F.ceil(F.col("n_bytes") / chunk), F.lit(1))).otherwise(1).cast("int")
    numbered = joined.select("page_id", "url", "sha", "n_bytes", F.when(~stored, F.col("first")).alias("refers_to"), stored.alias("stored"), "body", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk_no"))
    data = F.when(F.col("stored"), F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    last = ~F.col("stored") | ((F.col("chunk_no") + 1) * chunk >= F.col("n_bytes"))
    return numbered.select("page_id", "url", "sha", "n_bytes", "refers_to", "stored", "chunk_no", last.alias("last"), data.alias("data"))


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{sha}')}>"


def heads(page_id: int | None, url: str | None, sha: str, n_bytes: int, stored: bool, refers_to: int | None) -> bytes:
    """What stands in front of a payload: the record's fields and those of its HTTP message."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if stored else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32(sha)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (n_bytes if stored else 0)}",
    ]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if not stored:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stream the rows of :func:`record_table` into archives; returns the committed manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, count, size, digest, packer = TaskContext.get().partitionId(), 0, None, 0, 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, sha, n_bytes, refers_to, stored, chunk_no, last, data = row
                if out is None:
                    out = Writer(folder, f"part-{part:06d}-{seq:05d}.warc.gz")
                if chunk_no == 0:
                    digest, packer = hashlib.sha1(), zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(heads(page_id, url, sha, n_bytes, stored, refers_to)))
                if stored:
                    digest.update(data)
                    packed = packer.compress(data)
                    size += len(packed)
                    out.write(packed)
                if last:
                    if stored and digest.hexdigest() != sha:
                        raise ValueError(f"page {page_id}: chunks do not add up to the payload")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    count += 1
                    if size >= archive_bytes:
                        out.__exit__(None, None, None)
                        yield pa.RecordBatch.from_pylist([{"path": out.uri, "n_records": count, "n_bytes": size}], schema=_MANIFEST)
                        out, count, size, seq = None, 0, 0, seq + 1
        if out is not None:
            out.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"path": out.uri, "n_records": count, "n_bytes": size}], schema=_MANIFEST)

    spark, manifest = session_of(records), f"{folder}/manifest"
    records.mapInArrow(write, "path string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_archive(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, chunk_no, last, bytes so far, digest so far, data) of an open archive."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as text:
        while line := text.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"not a record: {line[:40]!r}")
            fields = _fields(text)
            left = int(fields["content-length"])
            kind, page, origin = fields["warc-type"], fields.get("x-page-id"), fields.get("x-refers-to-page-id")
            known = (int(page) if page else None, fields["warc-target-uri"], kind, int(origin) if origin else None)
            status = text.readline()
            http, used = {}, len(status)
            while (line := text.readline()) not in (b"\r\n", b""):
                used += len(line)
                name, _, value = line.decode().partition(":")
                http[name.lower()] = value.strip()
            left -= used + 2
            stated = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "revisit":
                yield *known, 0, True, int(http["content-length"]), stated, b""
            else:
                digest, seen, number = hashlib.sha1(), 0, 0
                while True:
                    data = text.read(min(chunk, left - seen))
                    digest.update(data)
                    seen += len(data)
                    last = seen >= left
                    so_far = base64.b32encode(digest.digest()).decode()
                    if last and so_far != stated or not data and not last:
                        raise ValueError(f"page {page}: the payload is not the one that was written")
                    yield *known, number, last, seen, so_far, data
                    number += 1
                    if last:
                        break
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where it should")


def _fields(text) -> dict[str, str]:
    out = {}
    while (line := text.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Stream archives back into chunk rows; lengths and digests are those of the payload up to the row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reader(path) as stream:
                    rows, held = [], 0
                    for row in read_archive(stream, chunk):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += len(row[-1]) if with_data else 256
                        if held >= 1 << 22:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    session_of(manifest)
    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, payload_bytes long, payload_digest string, data binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)


def archive(pages: DataFrame, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, a row a record."""
    folder = fresh_folder(session_of(pages), "archives")
    manifest = write_archives(record_table(pages, chunk), folder, archive_bytes)
    rows = read_chunks(manifest, chunk, with_data=False).where("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
