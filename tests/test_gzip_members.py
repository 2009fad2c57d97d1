"""Gzipped files of several members, read in ranges: every line once, in order."""

import gzip
import random

import pytest

from quern.sources import files
from quern.sources import gzip_members as G


def written(path, seed, members, longest=400, last_end=True):
    """A file of ``members``, cut at any byte of its text; returns its lines."""
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcé \x1f") for _ in range(rng.randrange(longest))) for _ in range(rng.randrange(1, 400))]
    data = "\n".join(lines).encode() + (b"\n" if last_end else b"")
    cuts = sorted(rng.randrange(len(data) + 1) for _ in range(members - 1))
    with open(path, "wb") as f:
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            f.write(gzip.compress(data[a:b], rng.choice([0, 1, 9])))
    return data.decode().split("\n")[: len(lines) if lines[-1] or last_end else len(lines) - 1]


@pytest.mark.parametrize("seed", range(12))
def test_ranges_of_any_size_give_every_line_once(tmp_path, monkeypatch, seed):
    path = str(tmp_path / "a.gz")
    want = written(path, seed, [1, 2, 7, 40][seed % 4], last_end=seed % 3 != 0)
    with gzip.open(path) as f:
        assert f.read().decode().split("\n")[: len(want)] == want
    monkeypatch.setattr(G, "BLOCK", [1 << 20, 700][seed % 2])
    size = (tmp_path / "a.gz").stat().st_size
    for step in (53, 1000, 10_000, size):
        got = [x.decode() for a in range(0, size, step) for x in G.lines_of(path, a, min(size, a + step))]
        assert got == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "b.gz")
    with open(path, "wb") as f:
        for i in range(40):
            f.write(gzip.compress("".join(f"line {i * 500 + k}\n" for k in range(500)).encode()))
    found = files.gzip_lines(spark, f"file://{path}", range_bytes=4000)
    assert found.columns == ["row_index", "value"]
    rows = found.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(20_000)) and [r.value for r in rows] == [f"line {i}" for i in range(20_000)]
    spark.dataSource.register(G.GzipMembers)
    parts = spark.read.format("gzip_members").option("bytes", 4000).load(path).groupBy("part").count().collect()
    assert len(parts) > 5
    whole = files.indexed_lines(spark, path).orderBy("row_index").collect()
    assert [r.value for r in whole] == [r.value for r in rows]


def test_damage_and_emptiness(spark, tmp_path):
    good = gzip.compress(b"one\ntwo\n" * 5000)
    (tmp_path / "cut.gz").write_bytes(good[: len(good) // 2])
    with pytest.raises(EOFError):
        list(G.lines_of(str(tmp_path / "cut.gz"), 0, 10**6))
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "nothing.gz").write_bytes(gzip.compress(b"") * 3 + b"\0" * 20)
    for name in ("empty.gz", "nothing.gz"):
        assert files.gzip_lines(spark, str(tmp_path / name)).count() == 0
    with pytest.raises(Exception, match="nothing at"):
        files.gzip_lines(spark, str(tmp_path / "none.gz")).count()
