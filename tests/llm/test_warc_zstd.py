import base64
import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard

from quern.llm import warc_zstd as Z

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://b/ x\r\ny", "<p>one</p>"), (4, "http://c/", ""), (5, "u", "é\r\n\r\n" * 500),
    (6, "u", "x" * 2_000_000), (7, "u", "<p>one</p>"), (8, "u", "\r\n\r\n"), (9, "u", "WARC/1.1\r\n"), (7, "u", "<p>one</p>"), (None, "n", "solo"),
]


def test_write_and_read_back(spark):
    df = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id bigint, url string, html string, n int, digest string")
    rows = Z.read_archives(Z.write_archives(df, Z.ArchiveOptions(archive_bytes=1 << 12))).collect()
    assert len(rows) == len(PAGES) and not any(r.error for r in rows)
    by = defaultdict(list)
    for page, _, html in PAGES:
        by[(html or "").encode()].append(page)
    seen = defaultdict(list)
    for r in rows:
        seen[r.page_id].append(r)
    for payload, ids in by.items():
        for page in ids:
            for r in seen[page]:
                assert r.payload_bytes == len(payload)
                assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                top = max(i for i in ids if i is not None) if ids != [None] else None
                assert (r.record_type, r.refers_to) == (("response", None) if page == top else ("revisit", top))
                assert r.payload is None if page != top else bytes(r.payload) == payload
    assert Z.read_archives(Z.write_archives(df.limit(0))).count() == 0


def test_small_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    rows = Z.read_archives(Z.write_archives(df, Z.ArchiveOptions(revisit_from=3)), payloads=False).collect()
    assert {r.page_id: r.record_type for r in rows} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_shuffled_join_path_agrees(spark):
    df = spark.createDataFrame([(i, "u", f"p{i % 7}") for i in range(100)], "page_id bigint, url string, html string")
    got = [
        sorted((r.page_id, r.record_type, r.refers_to) for r in Z.read_archives(Z.write_archives(df, Z.ArchiveOptions(broadcast_rows=n)), payloads=False).collect())
        for n in (0, 1000)
    ]
    assert got[0] == got[1] and sum(k == "response" for _, k, _ in got[0]) == 7


def test_dictionary_comes_from_the_leading_frame():
    o = Z.ArchiveOptions()
    records = [Z.record(i, "u", f"<html><body>page {i} shared words shared words</body></html>".encode() * 5, None, False, o) for i in range(300)]
    data = Z.pack_archive(records, o)
    magic, size = struct.unpack_from("<II", data)
    assert magic == Z.DICTIONARY_MAGIC
    assert list(Z.unpack_archive(data)) == records
    with pytest.raises(zstandard.ZstdError):  # the frames need it
        zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])
    more = data[: 8 + size] + struct.pack("<II", Z.SKIPPABLE_FIRST, 3) + b"abc" + data[8 + size :]
    assert list(Z.unpack_archive(more)) == records


@pytest.mark.parametrize("cut", [5, 20, 700])
def test_truncated_archives_are_reported(spark, cut):
    o = Z.ArchiveOptions()
    data = Z.pack_archive([Z.record(i, "u", b"x" * 300, None, False, o) for i in range(3)], o)
    rows = Z.read_archives(spark.createDataFrame([(data[: min(cut, len(data) - 2)],)], "archive binary")).collect()
    assert rows[-1].error


def test_broken_records_are_reported():
    o = Z.ArchiveOptions()
    good = Z.record(1, "u", b"payload", None, False, o)
    assert Z.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n", b"paylaod\r\n"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(Z.WarcError):
            Z.parse(bad)


def warc(kind, block, *more, version=b"WARC/1.0", name=b"<urn:uuid:11111111-2222-3333-4444-555555555555>"):
    head = [version, b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, b"WARC-Date: 2020-01-01T00:00:00Z", *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers_are_read():
    info = Z.parse(warc(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields"))
    assert (info["record_type"], info["payload_bytes"], info["page_id"]) == ("warcinfo", 13, None)
    assert info["record_id"] == "urn:uuid:11111111-2222-3333-4444-555555555555"
    request = Z.parse(warc(b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type: application/http; msgtype=request"))
    assert request["payload"].startswith(b"GET")
    http = b"Content-Type: application/http; msgtype=response"
    plain = Z.parse(warc(b"response", b"HTTP/1.0 404 Not Found\r\nX: y\r\n folded\r\n\r\nbody", http, b"WARC-Target-URI: http://a/"))
    assert (plain["payload"], plain["url"], plain["payload_digest"]) == (b"body", "http://a/", Z.digest_of(b"body"))
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nbody\r\n2\r\n!!\r\n0\r\n\r\n"
    for payload in (b"body!!", chunks.partition(b"\r\n\r\n")[2]):
        digest = b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
        assert Z.parse(warc(b"response", chunks, http, digest))["payload"] == b"body!!"
    sha256 = b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"body").hexdigest().encode()
    assert Z.parse(warc(b"resource", b"body", b"Content-Type: text/plain", sha256))["payload_bytes"] == 4
    profile = b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified"
    again = Z.parse(warc(b"revisit", b"", http, profile, b"WARC-Refers-To: <urn:uuid:1>"))
    assert (again["refers_to"], again["refers_to_id"], again["payload"], again["payload_digest"]) == (None, "urn:uuid:1", None, None)
    for bad in (
        warc(b"response", b"no http at all", http), warc(b"revisit", b"", http, profile), warc(b"revisit", b"", http, b"WARC-Refers-To: <urn:uuid:1>"),
        warc(b"response", chunks[:-12], http), warc(b"resource", b"bodY", sha256), warc(b"warcinfo", b"", name=b"urn:uuid:1"),
        warc(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nbody", http),
    ):
        with pytest.raises(Z.WarcError):
            Z.parse(bad)
    cut = warc(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nbody", http, b"WARC-Truncated: length")
    assert Z.parse(cut)["payload"] == b"body"


def test_frames_of_an_absent_dictionary_are_reported(spark):
    o = Z.ArchiveOptions()
    data = Z.pack_archive([Z.record(i, "u", b"words and words " * 40, None, False, o) for i in range(200)], o)
    size = struct.unpack_from("<II", data)[1]
    rows = Z.read_archives(spark.createDataFrame([(data[8 + size :],)], "archive binary")).collect()
    assert len(rows) == 1 and rows[0].error
    # Plain frames without any dictionary are fine.
    bare = b"".join(zstandard.ZstdCompressor().compress(Z.record(i, "u", b"p", None, False, o)) for i in range(3))
    rows = Z.read_archives(spark.createDataFrame([(bare,)], "archive binary")).collect()
    assert [r.page_id for r in rows] == [0, 1, 2] and not any(r.error for r in rows)


def test_revisits_are_held_against_their_responses(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    rows = Z.read_archives(Z.write_archives(df))
    assert Z.unmet_revisits(rows).count() == 0
    lost = rows.filter("not (record_type = 'response' and page_id = 7)")
    assert sorted(r.page_id for r in Z.unmet_revisits(lost).collect()) == [1, 3]
    other = rows.withColumn("payload_bytes", rows.payload_bytes + (rows.page_id == 1).cast("int"))
    assert [r.page_id for r in Z.unmet_revisits(other).collect()] == [1]
