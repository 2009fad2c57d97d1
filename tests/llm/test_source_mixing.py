"""Source mixing against plain arithmetic and its contract."""

from collections import Counter, defaultdict

import pytest

from quern.llm import source_mixing as X


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id bigint, text string, source string, size int, src string")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def corpus(n=400, sources=7):
    out = [(i, " ".join(["w"] * ((i * 37) % 300)), None if i % 41 == 0 else f"src{(i * i) % sources if i % 3 else 0}") for i in range(n)]
    return out + [(n, "long " * 20000, "src3"), (n + 1, None, "src1"), (n + 2, "", "only empty"), (None, "a b c", "src2"), (5, "x y", "src2")]


@pytest.mark.parametrize("p", [X.Mix(), X.Mix(block=16, run_rows=30, chunk=64, cells=8), X.Mix(broadcast_rows=0, block=100)])
def test_contract(spark, p):
    rows = corpus()
    documents, pieces = X.mix(table(spark, rows), p)
    got = documents.collect()
    assert len(got) == len(rows)
    sizes, src = defaultdict(int), {}
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = plain_targets(sizes), Counter()
    names = {v: k for k, v in sizes.items()}
    for r in got:
        s = names[r.source_size]
        assert r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, X.mix(table(spark, rows), p)[0].collect()))
    by_slot = pieces.groupBy("slot").sum("n").collect()
    assert max(r[1] for r in by_slot) <= p.block
    total = sum(r.taken for r in got)
    assert sum(r[1] for r in by_slot) == total
    # Every stretch of the mix is near the target shares.
    source_of = {i: s for i, _, s in rows}
    seen = Counter()
    for r in pieces.orderBy("slot").collect():
        seen[source_of[r.doc_id]] += r.n
        done = sum(seen.values())
        if done > total / 3 and p.block <= 100:
            assert all(abs(seen[s] / done - want[s] / sum(want.values())) < 0.03 for s in ("src0", "src1", "src3"))


def test_empty_tables(spark):
    assert X.report(table(spark, corpus()).limit(0)).count() == 0
    none = X.report(table(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2


def test_mixed_documents_have_the_taken_words(spark):
    rows = corpus(60, 4)[:-1]
    df = table(spark, rows)
    out = X.mixed_documents(df)
    assert out.columns == df.columns
    words, text = Counter(), {i: t or "" for i, t, _ in rows}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert text[r.doc_id].startswith(r.text)
    want = {r.doc_id: r.taken for r in X.report(df).collect() if r.taken}
    assert words == want


def test_rows_that_share_an_id_are_taken_as_documents_of_their_own(spark):
    rows = [(5, "a b c d e f g h", "s"), (5, "i j k l m n o", "s"), (5, "a b c d e f g h", "s"), (None, "p q", "s"), (None, "p q", None), (6, None, "s"), (7, "", None)]
    rows += [(10 + i, f"w{i} " * (i % 9 + 1), f"s{i % 4}") for i in range(80)]
    df = table(spark, rows)
    for p in (X.Mix(), X.Mix(block=4, run_rows=20)):
        documents, _ = X.mix(df, p)
        want = Counter()
        for r in documents.collect():
            want[r.doc_id, r.size] += r.taken
        got, copies = Counter(), Counter()
        for r in X.mixed_documents(df, p).collect():
            mine = [t for i, t, s in rows if i == r.doc_id and s == r.source and t and t.startswith(r.text)]
            assert mine and r.text.split()
            copies[r.doc_id, r.source, mine[0]] += len(r.text.split())
            got[r.doc_id, len(mine[0].split())] += len(r.text.split())
        assert got == +want
        for (i, s, t), n in copies.items():
            assert n <= 2 * len(t.split()) * sum(row == (i, t, s) for row in rows)


def test_stage_is_in_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (20 + i * 7 % 60)), f"src{i % 5 if i % 3 else 0}") for i in range(1500)]
    df = table(spark, rows)
    p = X.Mix(block=32)
    X.mixed_documents(df, p).write.parquet(f"{tmp_path}/out")
    want = {s: 0 for s in {s for _, _, s in rows}}
    for r in X.mixed_documents(df, p).collect():
        want[r.source] += len(r.text.split())
    total, seen, done = sum(want.values()), Counter(), 0
    for path in sorted(tmp_path.glob("out/part-*.parquet")):
        for r in spark.read.parquet(str(path)).collect():
            seen[r.source] += len(r.text.split())
            done += len(r.text.split())
            if done > 2000:
                assert all(abs(seen[s] / done - want[s] / total) < 0.05 for s in want)
    assert done == total and len(list(tmp_path.glob("out/part-*.parquet"))) > 1


def test_golden_points_keep_their_precision():
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    phi = (Decimal(5).sqrt() - 1) / 2
    for n in (1, 1 << 20, (1 << 40) + 12345):
        exact = n * phi % 1
        point = (n >> 20) * X.PHI_20 + (n & ((1 << 20) - 1)) * X.PHI
        assert abs(float(exact) - point % 1) < 1e-4
