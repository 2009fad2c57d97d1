"""Vector codes: heaps against a plain Lloyd that measures everything, and edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import vector_codes as M

DDL = "vec_id bigint, label int, embedding array<float>"


def plain(rows, p):
    """{row number: (code, error)}, label sums and the final books, by measuring every part in every round. Rows are
    (vec_id, label, vector) and usable."""
    x = np.array([[int(np.floor(float(np.float32(v)) * p.scale)) for v in r[2]] for r in rows], dtype=object)
    n, dims = x.shape
    size = dims // p.parts
    order = sorted(range(n), key=lambda i: (rows[i][0], [float(np.float32(v)) for v in rows[i][2]]))[: p.entries]
    books = [[list(x[i][q * size : (q + 1) * size]) for i in order] for q in range(p.parts)]

    def assign():
        out = np.zeros((n, p.parts), int)
        gaps = np.zeros(n, object)
        for q in range(p.parts):
            for i in range(n):
                part = x[i][q * size : (q + 1) * size]
                d = [sum((a - b) ** 2 for a, b in zip(part, c, strict=True)) for c in books[q]]
                out[i, q] = min(range(len(d)), key=lambda e: (d[e], e))
                gaps[i] += d[out[i, q]]
        return out, gaps

    for _ in range(p.rounds):
        got, _ = assign()
        for q in range(p.parts):
            for e in range(len(books[q])):
                of = np.flatnonzero(got[:, q] == e)
                if len(of):
                    books[q][e] = [sum(x[i][q * size + j] for i in of) // len(of) for j in range(size)]
    got, gaps = assign()
    label = {}
    for r, g in zip(rows, gaps, strict=True):
        label[r[1]] = label.get(r[1], 0) + g
    books_sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return ["".join(f"{e:02x}" for e in g) for g in got], list(gaps), label, books_sha


def drawn(seed, n, dims, labels=3, grid=None):
    """Clustered vectors; with ``grid`` on few values, so that ties abound."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dims))
    v = centres[rng.integers(0, 5, n)] + rng.normal(0, 0.1, (n, dims))
    v = np.round(v * grid) / grid if grid else v
    return [(int(i), int(rng.integers(labels)), [float(np.float32(a)) for a in row]) for i, row in zip(rng.permutation(n), v, strict=True)]


@pytest.mark.parametrize(("seed", "n", "grid", "rounds", "entries"), [(1, 90, None, 2, 8), (2, 150, 4, 2, 16), (3, 120, 8, 5, 6), (4, 5, None, 2, 8), (5, 40, 2, 3, 1)])
def test_heaps_give_what_plain_rounds_give(spark, seed, n, grid, rounds, entries):
    p = M.CodeParams(parts=4, entries=entries, rounds=rounds, block_bytes=4 * 8 * 13)
    rows = drawn(seed, n, 8, grid=grid)
    codes, gaps, label, books = plain(rows, p)
    got = {r.vec_id: r for r in M.report(spark.createDataFrame(rows, DDL).repartition(3), p).collect()}
    assert len(got) == n
    for (i, k, _), code, gap in zip(rows, codes, gaps, strict=True):
        assert (got[i].code, got[i].error, got[i].label_error, got[i].codebooks_sha256) == (code, gap, label[k], books)


def test_later_rounds_measure_only_what_drift_has_violated(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = M.fit(vectors, M.CodeParams(rounds=4))
    assert found.measured[0] == 2000 * 16
    assert all(m < 2000 * 16 for m in found.measured[1:]) and found.measured[-1] < 0.9 * 2000 * 16


def test_bounds_hold_in_every_round():
    """The entry of a part that stays in its heap is the one that a new measure of all parts gives."""
    rng = np.random.default_rng(3)
    parts = rng.integers(-60, 60, (700, 3, 4)).astype(np.int32)
    books = rng.integers(-60, 60, (3, 9, 4)).astype(np.int64)
    block, drift = M.Block.first(parts, books), np.zeros((3, 9))
    skipped = 0
    for _ in range(12):
        books, lost, moved = M.replaced(books, block.sums, block.counts)
        drift = drift + lost
        block = M.Block.unpacked(block.packed(), 3, 9, 4)
        block.again(books, drift, moved)
        fresh = M.Block.first(parts, books)
        assert (block.entry == fresh.entry).all() and (block.sums == fresh.sums).all() and (block.counts == fresh.counts).all()
        assert sum(map(len, block.heaps)) == 2100
        skipped += 2100 - block.measured
    assert skipped > 2100


def test_large_numbers_are_exact():
    x = np.array([[2_000_000_000, -2_000_000_000], [1_999_999_999, 7]], np.int64)
    book = np.array([[1_999_999_999, -2_000_000_000], [0, 7]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x // 2]
    assert M.squared(x // 2, book).tolist() == want


def test_dropped_odd_and_repeated_rows(spark):
    p = M.CodeParams(parts=2, entries=4)
    nan, inf = float("nan"), float("inf")
    good = [(1, 1, [0.1, 0.2, 0.3, 0.4]), (2, None, [0.5, -0.25, 0.0, 0.1]), (2, None, [0.5, -0.25, 0.0, 0.1]), (3, None, [-0.1, 0.9, 0.3, 0.2]), (9, 1, [0.1, 0.2, 0.3, 0.4])]
    bad = [(4, 1, None), (5, 1, [0.1, None, 0.2, 0.3]), (6, 1, [nan, 0.0, 0.0, 0.0]), (7, 1, [0.0, inf, 0.0, 0.0])]
    odd = [(8, 2, [0.1, 0.2]), (10, 2, [1e30, 0.0, 0.0, 0.0]), (11, 1, [])]
    codes, gaps, label, books = plain(good, p)
    docs = spark.createDataFrame(good + bad + odd, DDL).withColumns({"key": F.lit("x"), "code": F.lit(1), "vector": F.lit(2)})
    got = sorted(M.report(docs, p).collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in got] == [1, 2, 2, 3, 8, 9, 10, 11]
    by_id = {r.vec_id: r for r in got}
    for (i, k, _), code, gap in zip(good, codes, gaps, strict=True):
        assert (by_id[i].code, by_id[i].error, by_id[i].label_error, by_id[i].codebooks_sha256) == (code, gap, label[k], books)
    assert all(by_id[i].code is None and by_id[i].error is None for i in (8, 10, 11)) and by_id[8].label_error is None
    empty = M.report(docs.limit(0), p)
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        M.report(docs, M.CodeParams(parts=3))


def test_many_labels_are_joined_without_broadcast_of_all(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i, "00", i) for i in range(3000)], "key bigint, label bigint, code string, error bigint")
    want = {r.key: r.label_error for r in M.with_label_errors(rows, 10_000).collect()}
    got = {r.key: r.label_error for r in M.with_label_errors(rows, 10).collect()}
    assert got == want and len(got) == 3000 and got[0] == sum(range(0, 3000, 3)) and got[4] == 4
