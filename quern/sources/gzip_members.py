"""Lines of gzipped files that consist of several members (as bgzip, or appending one gzipped file to another, makes
them), read by many tasks.

    spark.dataSource.register(GzipMembers)
    spark.read.format("gzip_members").option("bytes", 64 << 20).load(path)  # part, line, value

A file is cut into ranges of bytes. A task inflates the members that begin in its range, each found by its
header and proved by inflating it (its checksum ends it), and gives the lines that begin in them: it leaves the end of a line
begun before to the task before, and reads on in the next members for the end of its own last line. A
file of a single member is read whole by its first task. Files lie on a file system that driver and executors mount.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "part int, line bigint, value string"
MAGIC = b"\x1f\x8b\x08"
RANGE, BLOCK, ROWS = 64 << 20, 1 << 20, 8192
#: Inflated bytes that prove a header to be one.
PROOF = 1 << 16


class Bytes(InputPartition):
    def __init__(self, part: int, path: str, begin: int, end: int):
        super().__init__(part)
        self.part, self.path, self.begin, self.end = part, path, begin, end


def begins_member(path: str, at: int) -> bool:
    """Whether a member begins at byte ``at``: its first bytes inflate, or it ends with the right checksum."""
    with open(path, "rb") as f:
        f.seek(at)
        inflate, made = zlib.decompressobj(31), 0
        while made < PROOF and not inflate.eof:
            data = f.read(PROOF)
            if not data:
                return False
            try:
                while data and made < PROOF and not inflate.eof:
                    made += len(inflate.decompress(data, PROOF))
                    data = inflate.unconsumed_tail
            except zlib.error:
                return False
    return True


def next_member(path: str, begin: int, end: int) -> int | None:
    """Where the first member in the range begins; None where none does."""
    with open(path, "rb") as f:
        at, tail = begin, b""
        f.seek(begin)
        while at < end:
            data = tail + f.read(BLOCK)
            if len(data) <= len(tail):
                return None
            first = at
            found = data.find(MAGIC)
            while found >= 0 and first + found < end:
                if found + 3 < len(data) and not data[found + 3] & 0xE0 and begins_member(path, first + found):
                    return first + found
                if found + 3 >= len(data):
                    break  # the flags are in the next block
                found = data.find(MAGIC, found + 1)
            tail = data[-3:]
            at = first + len(data) - len(tail)
    return None


def inflated(path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(where the member began, some of its data), member after member from ``begin`` to the end of the file."""
    with open(path, "rb") as f:
        f.seek(begin)
        at, inflate, data = begin, zlib.decompressobj(31), f.read(BLOCK)
        while data:
            out = inflate.decompress(data, BLOCK)
            if out:
                yield at, out
            if inflate.eof:
                data = inflate.unused_data or f.read(BLOCK)
                at = f.tell() - len(data)
                inflate = zlib.decompressobj(31)
                if data and not data.strip(b"\0"):  # padding behind the last member
                    return
            else:
                data = inflate.unconsumed_tail or f.read(BLOCK)
        if at < f.tell() and not inflate.eof and f.tell() > at:
            raise EOFError(f"{path} ends within a member")


def lines_of(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in members which begin in the range, without their ends (\\n or \\r\\n)."""
    first = begin if begin == 0 else next_member(path, begin, end)
    if first is None or os.path.getsize(path) == 0:
        return
    held: list[bytes] = []
    skip = begin > 0  # what comes before the first line end belongs to the range before
    for at, data in inflated(path, first):
        past = at >= end
        pieces = data.split(b"\n")
        for piece in pieces[:-1]:
            if skip:
                skip = False
            else:
                yield b"".join([*held, piece]).removesuffix(b"\r")
            held = []
            if past:  # the last line that began in the range has ended; the next one began beyond
                return
        if not skip:
            held.append(pieces[-1])
    if any(held):
        yield b"".join(held).removesuffix(b"\r")


class GzipReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Bytes]:
        top = self.path.removeprefix("file://")
        paths = sorted(glob.glob(os.path.join(top, "*.gz"))) if os.path.isdir(top) else sorted(glob.glob(top))
        if not paths:
            raise FileNotFoundError(f"there is nothing at {self.path}")
        ranges = [(p, a, min(a + self.size, n)) for p in paths for n in [os.path.getsize(p)] for a in range(0, n, self.size)]
        return [Bytes(i, *r) for i, r in enumerate(ranges)] or [Bytes(0, paths[0], 0, 0)]

    def read(self, part: Bytes) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        line = 0

        def out() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([part.part] * n, pa.int32()), pa.array(range(line, line + n), pa.int64()), pa.array(held, pa.string())], ["part", "line", "value"])

        for data in lines_of(part.path, part.begin, part.end):
            held.append(data.decode("utf-8", "replace"))
            if len(held) == ROWS:
                yield out()
                line += len(held)
                held.clear()
        if held:
            yield out()


class GzipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GzipReader:
        return GzipReader(self.options["path"], int(self.options.get("bytes", RANGE)))
