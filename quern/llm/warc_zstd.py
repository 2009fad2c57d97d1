"""WARC archives in Zstandard: writing and reading.

An archive is a leading skippable frame that holds the dictionary, then one frame per
record compressed with it. Archives live in a binary column of a table in the shared
folder, so Spark's own committer writes them, a lost executor costs one task, and the
reader also takes files loaded with ``spark.read.format("binaryFile")``.

Records with equal payloads are stored once: the one with the largest id is the response,
all others are revisits that point to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import stash

# Fixed values of the formats.
SKIPPABLE_FIRST, SKIPPABLE_LAST, DICTIONARY_MAGIC = 0x184D2A50, 0x184D2A5F, 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_PROFILES = tuple(f"http://netpreserve.org/warc/{v}/revisit/{k}" for v in ("1.0", "1.1") for k in ("identical-payload-digest", "server-not-modified"))


@dataclass(frozen=True)
class ArchiveOptions:
    revisit_from: int = 0  # payloads below this many bytes are always stored as responses
    archive_bytes: int = 4 << 20  # an archive is closed beyond this size
    dictionary_bytes: int = 16 << 10
    dictionary_samples: int = 200
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"  # the capture time of tables that have none
    broadcast_rows: int = 100_000  # repeated digests are broadcast up to this many


class WarcError(ValueError):
    """An archive or record that breaks the format."""


# --- records -----------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, o: ArchiveOptions) -> bytes:
    """One record. A revisit has the HTTP header only; the header gives the full payload's length."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", o.date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _header_fields(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case to values; a line that begins with a space goes on with the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError("a header line without a colon")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def _page_of(uri: str | None) -> int | None:
    """The page id of a record id that this module wrote, else null."""
    own = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(own[1]) if own else None


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        start = end + 2
        if size < 0 or start + size > len(body):
            raise WarcError("a chunked body that breaks off")
        if size == 0:
            return b"".join(out)
        out.append(body[start : start + size])
        at = start + size + 2


def _agrees(payload: bytes, digest: str) -> bool:
    """Whether a labelled digest (base32 or hex) is the payload's; algorithms unknown here pass."""
    name, _, value = digest.partition(":")
    try:
        made = hashlib.new(name.lower().replace("-", ""), payload).digest()
    except (ValueError, TypeError):
        return True
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def parse(raw: bytes) -> dict:
    """The fields of one record of WARC 1.0 or 1.1; raises WarcError where version, lengths or digest are wrong.

    A response's payload is its HTTP body, its chunks joined; that of a record without HTTP
    (warcinfo, metadata, resource, and requests as well) is the whole block. A revisit has
    none: its length comes from the HTTP header, where there is one. A digest that is not
    given is taken from the payload. page_id and refers_to are those of ``record``; other
    record ids are given as they are, in record_id and refers_to_id.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in VERSIONS:
        raise WarcError("no WARC/1.0 or WARC/1.1 header")
    fields = _header_fields(lines)
    try:
        kind, length, name = fields["warc-type"].lower(), int(fields["content-length"]), fields["warc-record-id"]
    except (KeyError, ValueError):
        raise WarcError("a header is missing or malformed") from None
    if not name.startswith("<") or not name.endswith(">"):
        raise WarcError("a record id that is no URI in angle brackets")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    block, given = rest[:length], fields.get("warc-payload-digest")
    payload, size = block, len(block)
    if kind in ("response", "revisit") and (block or kind == "response") and fields.get("content-type", "application/http").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not http.startswith(b"HTTP/") or (kind == "response" and not gap):
            raise WarcError("the block is not an HTTP response")
        web = _header_fields(http.split(b"\r\n")[1:])
        told = web.get("content-length", "")
        told = int(told) if told.isdigit() else None
        if kind == "response" and "chunked" in web.get("transfer-encoding", "").lower():
            # Writers differ in whether the digest is of the body as it was sent.
            sent, payload, told = payload, _unchunked(payload), None
            given = None if given and _agrees(sent, given) else given
        if kind == "response" and told is not None and told != len(payload) and "warc-truncated" not in fields:
            raise WarcError("the payload's length differs from the HTTP header")
        size = len(payload) if kind == "response" else told
    refers = fields.get("warc-refers-to")
    if kind == "revisit":
        if payload and block:
            raise WarcError("a revisit record with a payload")
        if not refers and not fields.get("warc-refers-to-target-uri") or fields.get("warc-profile") not in REVISIT_PROFILES:
            raise WarcError("a revisit record without a known profile, or without what it refers to")
    elif given and "warc-truncated" not in fields and not _agrees(payload, given):
        raise WarcError("the payload's digest differs from its header")
    if kind != "revisit":
        digest = digest_of(payload)
    else:
        digest = given.removeprefix("sha1:") if given else None
    return {
        "page_id": _page_of(name),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(refers) if kind == "revisit" else None,
        "record_id": name[1:-1],
        "refers_to_id": refers.strip("<>") if refers else None,
        "payload": payload if kind != "revisit" else None,
    }


# --- archives ----------------------------------------------------------------------------


def dictionary_for(samples: list[bytes], o: ArchiveOptions) -> bytes:
    """A dictionary trained on the samples; with too few of them, their beginnings as they are."""
    try:
        return zstandard.train_dictionary(o.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(s[:1024] for s in samples) + bytes(8))[: o.dictionary_bytes]


def pack_archive(records: list[bytes], o: ArchiveOptions) -> bytes:
    step = max(1, len(records) // o.dictionary_samples)
    raw = dictionary_for([r[: 16 << 10] for r in records[::step][: o.dictionary_samples]], o)
    kind = zstandard.DICT_TYPE_AUTO
    packer = zstandard.ZstdCompressor(level=o.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_checksum=True)
    inner = zstandard.ZstdCompressor(level=o.level).compress(raw)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(inner)), inner, *map(packer.compress, records)])


def unpack_archive(data: bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one per frame; other skippable frames are passed over."""
    at, reader, first = 0, zstandard.ZstdDecompressor(), True
    view = memoryview(data)
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError("the archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 + size > len(data):
                raise WarcError("the archive ends inside a skippable frame")
            if first and magic == DICTIONARY_MAGIC:
                raw = bytes(view[at + 8 : at + 8 + size])
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            first = False
            continue
        first = False
        frame, out = reader.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise WarcError("the archive ends inside a record")
                fed = min(window, len(data) - at)
                out.append(frame.decompress(view[at : at + fed]))
                at += fed - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame that cannot be read: {e}") from None
        yield b"".join(out)


# --- tables ------------------------------------------------------------------------------

RECORD_DDL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string"
_RECORD = [
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
]


def with_revisits(pages: DataFrame, o: ArchiveOptions) -> DataFrame:
    """page_id, url, payload, response_id (the id that a repeated payload is stored under) of every page.

    Only digests with more than one page are joined back. They are counted first: up to
    ``broadcast_rows`` they are broadcast; beyond that a shuffled hash join builds on them
    and streams the pages, and Spark splits a digest that holds very many.
    """
    # Columns are renamed first so that extra columns cannot clash.
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    repeats = stash(
        base.filter(F.octet_length("payload") >= o.revisit_from)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-repeats",
    )
    if repeats.isEmpty():
        return base.withColumn("response_id", F.lit(None).cast("bigint")).withColumn("repeats", F.lit(False))
    small = repeats.count() <= o.broadcast_rows
    repeats = (F.broadcast(repeats) if small else repeats.hint("shuffle_hash")).withColumn("repeats", F.lit(True))
    joined = base.withColumn("digest", digest).join(repeats, "digest", "left").drop("digest")
    return joined.withColumn("repeats", F.coalesce("repeats", F.lit(False)))


def write_archives(pages: DataFrame, o: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """The archives (n_records, archive) of ``pages`` (page_id, url, html), written to the shared folder.

    A null html is an empty payload; a null url becomes about:blank. Pages that share both a
    payload and the largest id are all responses. An empty table gives no archive.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([pack_archive(held, o)], pa.binary())], ["n_records", "archive"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "response_id", "repeats")]
            for i in range(batch.num_rows):
                page, url, payload, target, again = (c[i].as_py() for c in columns)
                # In a group that repeats, every page but the one with the largest id revisits it.
                revisit = bool(again) and page != target
                held.append(record(page, url, payload, target, revisit, o))
                size += len(held[-1])
                if size >= o.archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return stash(with_revisits(pages, o).mapInArrow(run, "n_records bigint, archive binary"), "warc-archives")


def unmet_revisits(records: DataFrame) -> DataFrame:
    """The revisits of ``read_archives`` whose response is not among the records, or has another digest or length."""
    found = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("to_id"), F.col("payload_digest").alias("to_digest"), F.col("payload_bytes").alias("to_bytes"), F.lit(True).alias("met")
    )
    revisits = records.filter("record_type = 'revisit'")
    same = F.col("met") & F.coalesce(F.col("payload_digest") == F.col("to_digest"), F.lit(True)) & F.coalesce(F.col("payload_bytes") == F.col("to_bytes"), F.lit(True))
    joined = revisits.join(found.dropDuplicates(["to_id"]), F.col("refers_to_id") == F.col("to_id"), "left")
    return joined.filter(~F.coalesce(same, F.lit(False))).select(*records.columns)


def read_archives(archives: DataFrame, content: str = "archive", payloads: bool = True) -> DataFrame:
    """One row per record of the archives in column ``content``: RECORD_DDL, payload (with
    ``payloads``; null for revisits) and error (null for a valid record).

    A record that breaks the format gives a row with its error; so does an archive that
    cannot be read further, after the rows of the records before.
    """
    wanted = [(k, t) for k, t in _RECORD if payloads or k != "payload"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in wanted], [k for k, _ in wanted])

    def parsed(data: bytes) -> Iterator[dict]:
        try:
            for raw in unpack_archive(data):
                try:
                    yield parse(raw)
                except WarcError as e:
                    yield {"error": str(e)}
        except WarcError as e:
            yield {"error": str(e)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for row in parsed(value.as_py() or b""):
                    rows.append(row)
                    size += len(row.get("payload") or b"") if payloads else 200
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    ddl = RECORD_DDL + (", payload binary" if payloads else "") + ", error string"
    return archives.select(F.col(f"`{content}`").cast("binary").alias("data")).mapInArrow(run, ddl)
