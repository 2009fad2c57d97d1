"""What a search moves: it follows the cores and not the shuffle partitions, and stays exact where it is dealt out."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quern.operators import search
from tests.test_oracles import plain

SF = "/root/testdata/sf0.01"


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def records(spark) -> int:
    """Rows that all stages of the session have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def moved(spark, n: int) -> int:
    rng = np.random.default_rng(n)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))], "k bigint, embedding array<double>").coalesce(2)
    before = records(spark)
    found = search.blocked_candidates(corpus, corpus.withColumnRenamed("k", "query_id"), 10, "k")
    assert found.count() == 10 * n
    return records(spark) - before


def test_rows_moved_grow_as_the_input_and_not_with_the_partitions(spark, many_partitions):
    small, large = moved(spark, 400), moved(spark, 2400)
    assert large <= 6.5 * small
    # Every row once for each core, every query once, and a count or two.
    assert large <= (spark.sparkContext.defaultParallelism + 1) * 2400 + 100


def test_a_grid_moves_the_least(spark):
    assert search.grid(1000, 1000, 40, 264, 12) == (12, 1)  # best rows of more than one stripe would cost more
    assert search.grid(10, 10**6, 40, 264, 12) == (1, 12)  # a few queries go to all stripes
    groups, stripes = search.grid(10**6, 10**6, 40, 264, 100, least=9)
    assert groups >= 9 and groups * stripes >= 100
    for cells in (1, 7, 24):
        for rows in (0, 10**3, 10**7):
            groups, stripes = search.grid(10**4, rows, 40, 264, cells)
            assert groups * stripes >= cells


@pytest.mark.parametrize("n", [1, 3, 40])
def test_the_best_are_those_of_a_full_sort(n):
    rng = np.random.default_rng(n)
    best, seen, at = search.Best(30, n), [], np.arange(600)
    scores = np.round(rng.normal(size=(30, 600)), 1) + rng.choice([0.0, 4e-7, -4e-7, 6e-7], size=(30, 600))
    scores[:, rng.integers(0, 600, 20)] = np.nan
    for first in range(0, 600, 150):
        best.see(scores[:10, first : first + 150], at[first : first + 150], 0)
        best.see(scores[10:, first : first + 150], at[first : first + 150], 10)
    for q in range(30):
        seen = sorted((-(round(s, 6) + 0.0), k) for k, s in enumerate(scores[q].tolist()) if s == s)[:n]
        assert [k for _, k in seen] == best.keys[q].tolist() and np.allclose([-s for s, _ in seen], best.scores[q], atol=1e-9)


@pytest.mark.parametrize("name", ["requests_answered", "recommend_batch"])
def test_dealt_out_searches_agree_with_the_twin(spark, many_partitions, monkeypatch, name):
    monkeypatch.setattr(search, "FOUND_BYTES", 0)
    monkeypatch.setattr(search, "CELL_PAIRS", 10_000)  # more cells than cores: groups and stripes
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[want.columns]
    assert sorted((tuple(map(plain, r)) for r in got.itertuples(index=False)), key=repr) == sorted((tuple(map(plain, r)) for r in want.itertuples(index=False)), key=repr)
