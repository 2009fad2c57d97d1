"""Line dedup against a plain re-statement."""

import random
from collections import defaultdict

import pytest

from quern.llm import line_dedup as L


def plain(rows, least):
    sites, keeper = defaultdict(set), {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text, site in order:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(L.TRIM)
            if line:
                sites[line].add(site)
                keeper.setdefault(line, (i, pos))
    out = []
    for i, text, _ in rows:
        kept = [
            part for pos, part in enumerate((text or "").split("\n"))
            if not (line := part.strip(L.TRIM)) or len(sites[line]) < least or keeper[line] == (i, pos)
        ]
        out.append((i, None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, line string, hit int")


CASES = [
    (None, "null id\nshared", "s0"), (1, None, "s1"), (2, "", None), (3, "shared\n\nonly\n shared \r\nshared", "s2"), (4, "shared", "s3"),
    (5, "\n\n\nshared\n", "s4"), (6, "shared", "s4"), (6, "shared", "s4"), (7, "long\n" * 5000 + "shared\nend", "s5"), (8, "sharEd", "s6"),
]


@pytest.mark.parametrize("least", [2, 5, 7])
@pytest.mark.parametrize("limit", [0, 1000])
def test_matches_plain(spark, least, limit):
    out = L.dedup_lines(table(spark, CASES), L.LineDedup(min_sites=least, broadcast_rows=limit))
    assert out.columns == ["doc_id", "text", "source", "line", "hit", "line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == plain(CASES, least)


def test_random_with_many_sites(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line {int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 12))), f"s{rng.randint(0, 60)}") for i in range(800)]
    for p in (L.LineDedup(min_sites=12), L.LineDedup(min_sites=30, log_k=4)):
        assert sorted(((r.doc_id, r.text) for r in L.dedup_lines(table(spark, rows), p).collect()), key=repr) == plain(rows, p.min_sites)


def test_empty_table_and_line_counts(spark):
    df = table(spark, CASES)
    assert L.report(df.limit(0)).count() == 0
    for r in L.dedup_lines(df, L.LineDedup(min_sites=3)).collect():
        c = r.line_dedup
        assert c.n_left == c.n_lines - c.n_removed
        assert r.text is None or c.n_left in (len(r.text.split("\n")), 0)
