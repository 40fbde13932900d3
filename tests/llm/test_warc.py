import base64
import gzip
import hashlib
import io

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.files import fresh_folder

ROWS = [
    (5, "http://a/", "same"), (2, "http://b/ c\n", "same"), (9, None, "same"), (1, "http://d/", ""), (3, "http://e/", None), (4, "u", "é" * 1000), (6, "u", "x" * 5000), (7, "v", "x" * 5000),
    (8, "w", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n"), (8, "w", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n"), (None, "n", "same"), (None, "n", "alone"),
]


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "clash", 1, b"z") for r in rows], "page_id long, url string, html string, sha string, n_bytes int, data binary").repartition(3)

    return make


def expected(rows):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in body:
        if p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, b in body:
        own = first.get(b)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == own else "revisit", None if p == own else own))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "size"), [(7, 100), (1 << 18, 1 << 26)])
def test_edges(pages, chunk, size):
    got = warc.archive(pages(ROWS), chunk=chunk, archive_bytes=size).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS)
    assert warc.archive(pages([])).collect() == []


def test_chunks_carry_the_digest_so_far(spark, pages):
    manifest = warc.write_archives(warc.record_table(pages([(1, "u", "abcdefghij")]), chunk=4), fresh_folder(spark, "t"))
    rows = sorted(warc.read_chunks(manifest, chunk=4).collect(), key=lambda r: r.chunk_no)
    assert [bytes(r.data) for r in rows] == [b"abcd", b"efgh", b"ij"]
    assert [r.payload_bytes for r in rows] == [4, 8, 10] and [r.last for r in rows] == [False, False, True]
    assert [r.payload_digest for r in rows] == [base64.b32encode(hashlib.sha1(b"abcdefghij"[:n]).digest()).decode() for n in (4, 8, 10)]


def test_a_changed_payload_is_refused():
    sha = hashlib.sha1(b"abc").hexdigest()
    record = warc.heads(1, "u", sha, 3, True, None) + b"abx" + b"\r\n\r\n"
    with pytest.raises(ValueError, match="not the one"):
        list(warc.read_archive(io.BytesIO(gzip.compress(record))))


def test_a_record_is_never_held_whole(spark):
    big = spark.range(1).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789', 300000) AS html")
    table = warc.record_table(big, chunk=1 << 16)
    assert table.count() == -(-3_000_000 // (1 << 16))
    row = warc.archive(big, chunk=1 << 16).first()
    assert row.payload_bytes == 3_000_000 and row.payload_digest == base64.b32encode(hashlib.sha1(b"0123456789" * 300000).digest()).decode()
