"""Next-fit in parallel: blocks as functions of the open batch against one pass in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import batching as B


def plain(tokens, limits):
    fit = B.NextFit(*limits)
    return [fit.place(int(t)) for t in tokens]


def drawn(seed, n, most):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, most, n)
    t[rng.random(n) < 0.05] = 3 * most  # beyond the budget: alone
    return t.astype(np.int64)


@pytest.mark.parametrize("limits", [(1, 10), (3, 10), (4, 1), (7, 25), (50, 40), (5, 10_000)])
def test_summaries_compose_to_one_pass(limits):
    rng = np.random.default_rng(7)
    for seed in range(60):
        tokens = drawn(seed, int(rng.integers(1, 70)), 12)
        cuts = np.sort(rng.integers(0, len(tokens) + 1, int(rng.integers(0, 6))))
        parts = np.split(tokens, cuts)
        sums = [B.Summary.unpacked(B.Summary.of(p, *limits).packed()) for p in parts]
        want = plain(tokens, limits)
        # One after another, and grouped from the right and from the left.
        got, count, held, batch = [], 0, 0, -1
        for p, s in zip(parts, sums, strict=True):
            got += B.numbered(p, count, held, batch, limits).tolist()
            begun, count, held = s.after(count, held, limits)
            batch += begun
        assert got == want
        for order in (1, -1):
            whole = sums[::order][0]
            for s in sums[::order][1:]:
                whole = whole.then(s, limits) if order == 1 else s.then(whole, limits)
            assert whole.after(0, 0, limits) == (want[-1] + 1, want.count(want[-1]), int(tokens[len(want) - want.count(want[-1]) :].sum()))
            half = B.Summary.of(tokens[: len(tokens) // 2], *limits)
            if half.rows:
                state = half.after(0, 0, limits)
                rest = plain(np.concatenate([tokens[: len(tokens) // 2], tokens]), limits)
                assert state[0] + whole.after(*state[1:], limits)[0] == rest[-1] + 1


@pytest.mark.parametrize(("limits", "block", "n"), [((3, 10), 5, 200), ((16, 60), 16, 1000), ((256, 200_000), 1 << 16, 500), ((8, 7), 11, 1)])
def test_tables_are_numbered_as_in_one_pass(spark, limits, block, n):
    tokens = drawn(n, n, 12)
    rows = spark.createDataFrame([(int(i) * 3 - 50, int(t)) for i, t in enumerate(tokens)], "k bigint, n int").orderBy(F.rand(1)).repartition(5)
    found = B.batch_ids(rows, "k", "n", *limits, block_rows=block)
    assert found.columns == ["k", "n", "batch"]
    got = sorted((r.k, r.n, r.batch) for r in found.collect())
    assert [r[2] for r in got] == plain(tokens, limits) and [r[1] for r in got] == tokens.tolist()


def test_ties_nulls_strings_and_nothing(spark):
    rows = [("b", 4), ("a", None), (None, 3), ("b", 4), ("b", 2), ("b", 4), ("c", 9)]
    got = sorted(((r.k or "", r.n, r.batch) for r in B.batch_ids(spark.createDataFrame(rows, "k string, n int"), "k", "n", 3, 10, block_rows=3).collect()))
    ordered = sorted((k or "", n or 0) for k, n in rows)
    assert got == sorted((k, n, b) for (k, n), b in zip(ordered, plain([n for _, n in ordered], (3, 10)), strict=True))
    assert B.batch_ids(spark.createDataFrame([], "k string, n int"), "k", "n").count() == 0
    same = B.batch_ids(spark.range(4000).selectExpr("1 as k", "2 as n"), "k", "n", 7, 100, block_rows=64)
    assert sorted(r.batch for r in same.collect()) == [i // 7 for i in range(4000)]


def test_no_task_sees_all_rows(spark):
    found = B.batch_ids(spark.range(5000).selectExpr("id", "id % 50 as n"), "id", "n", 16, 300, block_rows=128)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert found.count() == 5000 and found.rdd.getNumPartitions() > 0
