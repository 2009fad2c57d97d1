"""Curation: golden cases, and random pools against a plain restatement."""

import random

from pyspark.sql import functions as F

from quern.operators import curation, search


def plain(pool, k, cap=2):
    chosen, seen, stores = [], set(), {}
    for capped in (True, False):
        for place, title, store in pool:
            if len(chosen) >= k or title in seen or (capped and store and stores.get(store, 0) >= cap):
                continue
            chosen.append(place)
            seen.add(title)
            stores[store] = stores.get(store, 0) + 1
    return chosen


def test_random_pools(spark):
    rng = random.Random(1)
    pools = {q: [(i + 1, f"t{rng.randint(0, 25)}", rng.choice(["", "a", "b", "c", "d"])) for i in range(rng.randint(1, 40))] for q in range(150)}
    rows = [(q, p, t, s, f"row{p}") for q, pool in pools.items() for p, t, s in pool]
    df = spark.createDataFrame(rows, "q int, place int, title_key string, store_key string, extra string")
    got = {}
    for r in curation.curate(df, F.lit(8), ["q"]).collect():
        assert r.extra == f"row{r.place}"
        got.setdefault(r.q, {})[r.rank] = r.place
    assert got == {q: dict(enumerate(plain(pool, 8), 1)) for q, pool in pools.items()}


def products(spark, rows):
    return spark.createDataFrame(rows, "product_id string, title string, store string, embedding array<float>")


def ranked(spark, rows, query, k, pool):
    df = products(spark, rows)
    best = search.top_candidates(df, search.unit(query, 2), search.pool_size(pool, k, len(rows)), "product_id")
    from pyspark.sql import Window

    keyed = best.withColumns({
        "place": F.row_number().over(Window.orderBy(F.desc("score"), F.asc("product_id"))), "q": F.lit(0),
        "title_key": curation.title_key(F.col("title"), F.col("product_id")), "store_key": curation.store_key(F.col("store")),
    })
    return [r.product_id for r in curation.curate(keyed, k, ["q"]).orderBy("rank").collect()]


def test_golden_cases(spark):
    ties = [("B0002", "b", None, [0.0, 1.0]), ("A0001", "a", None, [1.0, 0.0]), ("B0001", "c", None, [0.0, 1.0])]
    assert ranked(spark, ties, [1.0, 0.0], 3, 3) == ["A0001", "B0001", "B0002"]
    fill = [(f"A000{i}", f"t{i}", "One", [1.01 - i / 100, 0.0]) for i in (1, 2, 3, 4)] + [("B0001", "t5", "Other", [0.96, 0.0])]
    assert ranked(spark, fill, [1.0, 0.0], 4, 5) == ["A0001", "A0002", "B0001", "A0003"]
    blank = [(f"A{i}", " ", None, [1.0, 0.0]) for i in range(3)]
    assert len(ranked(spark, blank, [1.0, 0.0], 3, 3)) == 3
    assert ranked(spark, ties[:2], [1.0, 0.0], 10, 1) == ["A0001", "B0002"]


def test_query_vectors():
    import pytest

    assert search.unit([3.0, 4.0]) == [0.6, 0.8]
    for bad in ([0.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], []):
        with pytest.raises(ValueError):
            search.unit(bad, 2)
    for pool, k in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            search.pool_size(pool, k, 5)


def test_gate(spark):
    rows = [(1, 10, 4.0), (2, 9, 5.0), (3, 10, 3.9), (4, 50, float("nan")), (5, None, 4.5), (6, 11, None)]
    df = spark.createDataFrame(rows, "rank int, rating_number int, average_rating double")
    assert [r.rank for r in curation.quality_gate(df).collect()] == [1]


def test_batch_agrees_with_single(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, rng.random()]) + 0.01, rng.random()]) for i in range(300)]
    df = spark.createDataFrame(rows, "product_id bigint, embedding array<float>").repartition(5)
    asked = df.filter("product_id < 7").selectExpr("product_id as query_id", "embedding")
    got = {}
    for r in search.batch_candidates(df, asked, 12, "product_id").collect():
        got.setdefault(r.query_id, {})[r.place] = (r.product_id, r.score)
    for q in range(7):
        best = search.top_candidates(df, search.unit(rows[q][1]), 12, "product_id").collect()
        assert [(r.product_id, r.score) for r in best] == [got[q][i] for i in range(1, 13)]
