"""The Jaccard join against brute force over all pairs of small corpora."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest

from quern.llm import ngram_jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return sorted((name, len(sets[i]), least[find(i)]) for i, (name, _) in enumerate(rows))


def got(df, p=J.JaccardJoin()):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df, p)[0].collect())


def corpus(seed, n=250):
    """Copies, edits in several strengths, chains of edits, and boilerplate that most texts share."""
    rng = random.Random(seed)
    plate = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = WORD.findall(rng.choice(rows[-30:])[1])
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if words:
                    words[rng.randrange(len(words))] = f"e{rng.randint(0, 9**9)}"
            if rng.random() < 0.3:
                words = words[: int(len(words) * rng.uniform(0.7, 1))]
        else:
            words = [f"w{rng.randint(0, 9**9)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 60, 150]))]
            if kind > 0.7:
                words[len(words) // 2 : len(words) // 2] = plate
        rows.append((i * 3 + 1, (" " if i % 2 else "\n").join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n int, cls string").repartition(5)
    assert got(df) == brute(rows)


def test_other_paths_agree(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(df, replace(J.JaccardJoin(), broadcast_rows=0, block_queries=2, block_shingles=500, sketch_bits=6)) == brute(rows)


def test_edges(spark):
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four five", "One two three four FIVE", "É b c d e", "é b c d e", "a b c d e f" * 2, None, "long word " * 60000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (0, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    solo = spark.createDataFrame([(None, "a b"), (None, None), (4, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in J.join(solo)[0].collect() if r.n_shingles) == [(False, 4), (True, 4)]


def test_large_groups_of_near_copies_stay_linear(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    documents, links = J.join(df)
    assert {r.component_id for r in documents.collect()} == {0}
    assert links.count() < 6 * len(rows)


def test_keep_one(spark):
    rows = corpus(6, 120)
    df = spark.createDataFrame([(*r, None) for r in rows] + [(5000, None, 1)], "doc_id bigint, text string, to_id int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)} | {5000})


def test_divide_skip_counts_exactly():
    rng = np.random.default_rng(0)
    p = J.JaccardJoin()
    base = rng.choice(2**40, 300, replace=False).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(300) < rng.uniform(0.5, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.choice(2**41, rng.integers(0, 60)).astype(np.uint64)])))
    index = J.BlockIndex(list(range(60)), sets)
    for q in sets:
        wanted = np.sort(rng.choice(60, 40, replace=False))
        want = []
        for d in wanted:
            n = len(np.intersect1d(q, sets[d]))
            if n >= p.overlap(len(q), len(sets[d])):
                want.append((int(d), n))
        assert sorted(J.divide_skip(index, q, wanted, p)) == want


def test_merge_skip_matches_counting():
    rng = random.Random(7)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        t = rng.randint(1, 6)
        counts = {d: sum(d in x for x in lists) for d in range(30)}
        assert J.merge_skip([list(x) for x in lists], t) == {d: n for d, n in counts.items() if n >= t}


def test_components_match_union_find(spark):
    from quern.llm.components import components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)] + [(9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("rows_per_batch", [1, 3, 1000])
def test_lists_do_not_depend_on_batches(spark, rows_per_batch):
    rng = random.Random(9)
    p = J.JaccardJoin()
    rows = set()
    for c in range(60):
        s = rng.randint(4, 40)
        for token in rng.sample(range(40), 6):
            # Tokens from 30 on are dealt out in parts.
            rows.add((token, 1 + c % 4 if token >= 30 else 0, c, (s << 32) + rng.randint(0, p.probe(s) - 1)))
    rows = list(rows)
    rows += rng.choices(rows, k=50) + [(100 + i, 0, 5, (10 << 32)) for i in range(9)] + [(200, 3, 5, 10 << 32)]
    want = {}
    for token in {r[0] for r in rows}:
        group = {(salt, c, sp) for t, salt, c, sp in rows if t == token}
        if len(group) > 1 or token >= 200:
            want |= {(token, c): (sp >> 32, sp & 0xFFFFFFFF) for _, c, sp in group}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        got = J._lists(spark.createDataFrame(rows, "token bigint, salt bigint, cls bigint, sp bigint")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    assert {(r.token, r.cls): (r.size, r.pos) for r in got} == want


def linked(rows):
    """How many other sets the set of each row links with, over all pairs."""
    sets = {frozenset(shingle_set(t)) for _, t in rows} - {frozenset()}
    count = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets}
    return sorted((name, count.get(frozenset(shingle_set(t)), 0)) for name, t in rows)


def test_links_are_counted_exactly(spark):
    rows = corpus(4, 200)
    base = [f"w{i}" for i in range(60)]
    rng = random.Random(1)
    for i in range(80):  # one group, with links of every strength
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"e{rng.randint(0, 9)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for p in (J.JaccardJoin(), replace(J.JaccardJoin(), block_queries=5, block_shingles=400, long_list=4, hot_list=3, sketch_bits=8, salts=3)):
        assert sorted((r.doc_id, r.n_links) for r in J.count_links(df, p).collect()) == linked(rows)
        assert got(df, p) == brute(rows)
    assert J.count_links(df.limit(0)).count() == 0


def test_outsiders_do_not_stand_for_each_other():
    p = J.JaccardJoin()
    two = [np.arange(a, a + 40, dtype=np.uint64) for a in (0, 1000)]
    search = J.Search(J.BlockIndex([5, 6], two), p)
    for cls, own, doc in ((7, two[0], 0), (8, two[1], 1), (9, two[1], 1), (10, two[0], 0)):
        assert search.links(own, cls) == [(doc, 40)]
    both = np.concatenate([two[0], two[1][:9]])
    assert search.links(both, 11) == [(0, 40)] and search.links(two[0][:5], 12) == []


def test_every_link_is_one(spark):
    rows = corpus(5, 200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    documents, links = J.join(df)
    sets = {r.class_id: shingle_set(t) for r in documents.collect() for name, t in rows if name == r.doc_id}
    for r in links.collect():
        a, b = sets[r.a], sets[r.b]
        assert r.overlap == len(a & b) and 100 * len(a & b) >= 80 * len(a | b)
