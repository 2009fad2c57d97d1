"""Queries that take whole tables, where their tables go beyond the ids of the small batches."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quern.operators import search
from quern.plans import search_queries
from tests.test_oracles import plain

SF = "/root/testdata/sf0.01"
NAMES = (
    "recommend_batch", "query_validation", "category_signals_text", "explain_prompt", "explain_offline", "explanation_merge_integrity", "request_outcomes", "requests_answered",
    "batch_packing", "embed_job_batches", "embed_resume_waves", "pool_samples", "first_image_url", "transient_error_classify", "backoff_schedule",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {n: entry.queries()[n](spark, SF).toPandas() for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_twin(results, duck, name):
    want = duck.execute(entry.oracle_sql()[name]).df()
    got = results[name][want.columns]
    assert sorted((tuple(map(plain, r)) for r in got.itertuples(index=False)), key=repr) == sorted((tuple(map(plain, r)) for r in want.itertuples(index=False)), key=repr)


def test_nothing_is_left_out(results, duck):
    def one(sql):
        return duck.execute(sql).fetchone()[0]

    assert set(results["recommend_batch"].query_id) <= {r[0] for r in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()}
    assert results["recommend_batch"].query_id.max() >= 400
    assert len(results["query_validation"]) == one("SELECT count(*) FROM embeddings")
    assert results["request_outcomes"].n.sum() == one("SELECT count(*) FROM conversations WHERE role = 'user'")
    groups = one("SELECT count(DISTINCT p_partkey // 20) FROM part")
    assert len(results["explain_prompt"]) == len(results["explanation_merge_integrity"]) == groups > 20
    assert sum(p.count("Product rank ") for p in results["explain_prompt"].prompt) == len(results["explain_offline"]) == one("SELECT count(*) FROM part")


def test_groups_and_stripes_change_nothing(spark, results, monkeypatch):
    monkeypatch.setattr(search.blocked_candidates, "__defaults__", ("query_id", 64 * 8 * 3))
    got = search_queries.recommend_batch(spark, SF).toPandas()
    order = ["query_id", "rank"]
    want = results["recommend_batch"].sort_values(order).reset_index(drop=True)
    assert got.sort_values(order).reset_index(drop=True).equals(want)


def test_no_more_rows_leave_a_task_than_queries_times_n(spark):
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 8)))], "k bigint, embedding array<double>").repartition(6)
    asked = corpus.filter("k % 50 = 0").withColumnRenamed("k", "query_id")
    found = search.blocked_candidates(corpus, asked, 5, "k", query_bytes=8 * 8 * 20)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Broadcast" not in plan and "SinglePartition" not in plan
    groups, stripes = 4, 1  # 60 queries in groups of at most 20, for 4 partitions
    best = {q: [r.k for r in sorted(rows, key=lambda r: r.place)] for q, rows in _by_query(found.collect()).items()}
    v = np.array([r.embedding for r in corpus.orderBy("k").collect()])
    for q in range(0, 3000, 50):
        scores = np.round(v @ (v[q] / np.linalg.norm(v[q])), 6)
        assert best[q] == sorted(range(3000), key=lambda i: (-scores[i], i))[:5]
    assert len(best) == 60 and groups * stripes <= 8


def _by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


def test_ties_text_keys_and_nothing(spark):
    rows = spark.createDataFrame([(f"k{i % 97:02d}-{i}", [1.0, float(i % 3)]) for i in range(500)], "id string, embedding array<double>").repartition(7)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "query_id string, embedding array<double>")
    everything = rows.collect()
    for found in (search.batch_candidates(rows, asked, 9, "id"), search.blocked_candidates(rows, asked, 9, "id", query_bytes=16)):
        got = {(r.query_id, r.place): (r.id, r.score) for r in found.collect()}
        for q, at in (("a", 0), ("b", 1)):
            want = sorted(((r.embedding[at] + 0.0, r.id) for r in everything), key=lambda x: (-x[0], x[1]))[:9]
            assert [got[q, i + 1] for i in range(9)] == [(k, s) for s, k in want]
    for corpus, queries in ((rows.limit(0), asked), (rows, asked.limit(0))):
        assert search.blocked_candidates(corpus, queries, 3, "id").count() == search.batch_candidates(corpus, queries, 3, "id").count() == 0
    with pytest.raises(Exception, match="finite and not zero"):
        search.blocked_candidates(rows, asked.selectExpr("query_id", "array(0D, 0D) as embedding"), 3, "id").collect()


def test_queries_are_scored_in_blocks(spark):
    rows = spark.createDataFrame([(i, search.unit([i % 7 + 1, i % 5, 1])) for i in range(600)], "id bigint, embedding array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    got = search.batch_candidates(rows, asked, 2, "id")
    assert got.count() == 1200 and got.select("query_id").distinct().count() == 600
    best = {r.query_id: r.id for r in got.filter("place = 1").collect()}
    assert all(best[i] == i % 35 for i in range(600))
