"""Providers, embedding job, sources, explanations, requests and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import providers as M
from quern.operators import batching, embed_job, explain
from quern.sources import files, npy


def test_retry_and_fallback():
    class RateLimitError(Exception):
        pass

    class BadRequestError(Exception):
        pass

    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimitError("later")
        return "ok"

    assert M.with_retry(flaky, slept.append) == "ok" and slept == [1, 2]
    with pytest.raises(ValueError):
        M.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), slept.append)
    tried = []

    def one(model):
        tried.append(model)
        if model == "a":
            raise BadRequestError("the model does not exist")
        return model

    assert M.with_fallback(one, ("a", "b")) == "b" and tried == ["a", "b"]
    assert not M.wants_fallback(BadRequestError("bad input")) and M.is_transient(RateLimitError())
    assert [M.backoff(i) for i in range(7)] == [1, 2, 4, 8, 16, 30, 30]


def test_refusals(spark):
    said = {"output": [{"content": None}, {"content": [{"type": "text"}, {"type": "refusal", "refusal": "no"}, {"type": "refusal", "refusal": "later"}]}]}
    assert M.refusal_of(said) == "no" and M.refusal_of({"output": []}) is None
    df = spark.createDataFrame([(json.dumps(said),), ("{}",)], "r string")
    assert [r[0] for r in df.select(M.refusal_column(F.try_parse_json("r"))).collect()] == ["no", None]
    assert len(M.summary_of({"output": "x" * 5000})) < 1100


def test_answers_are_checked():
    assert M.checked_rows([[3.0, 4.0]], 1, 2).tolist() == [[pytest.approx(0.6), pytest.approx(0.8)]]
    for bad in ([], [[]], [[float("nan"), 1.0]], [[[1.0, 2.0]]], [[0.0, 0.0]]):
        with pytest.raises(M.ProviderError):
            M.checked_rows(bad, 1, 2)


def test_job_resumes_and_checks(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "row_index bigint, text string")
    out = str(tmp_path / "vectors")

    class Counting(M.HashEmbedder):
        pass

    embed_job.run(spark, texts.filter("row_index % 3 = 0"), M.HashEmbedder(8), out)
    left = embed_job.missing(texts, spark.read.parquet(out), "row_index")
    assert left.count() == 50 - 17
    manifest = embed_job.run(spark, texts, Counting(8), out, manifest_path=str(tmp_path / "m.json"))
    assert manifest["product_count"] == 50 and spark.read.parquet(out).select("row_index").distinct().count() == 50
    assert files.load_manifest(spark, str(tmp_path / "m.json"))["dimensions"] == 8
    with pytest.raises(Exception, match="more than 8192 tokens"):
        embed_job.run(spark, spark.createDataFrame([(1, "x" * 30_000)], "row_index bigint, text string"), M.HashEmbedder(8), str(tmp_path / "v2"))
    for bad in ((300_001, 1.0), (10, 0.0)):
        with pytest.raises(ValueError):
            batching.check_budget(*bad)


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "m.json")
    for text in (None, "{", "[]", '{"product_count": 1}'):
        if text is not None:
            (tmp_path / "m.json").write_text(text)
        with pytest.raises(ValueError):
            files.load_manifest(spark, path)
    good = {"product_count": 3, "dimensions": 2, "normalized": True}
    files.check_manifest(good, 3, 2)
    for change in ({"product_count": 4}, {"dimensions": 3}, {"normalized": 1}, {"product_count": True}, {"product_count": "3"}):
        with pytest.raises(ValueError):
            files.check_manifest(good | change, 3, 2)
    assert files.settings({"OPENAI_API_KEY": "  "})["api_key"] is None
    with pytest.raises(ValueError):
        files.settings({}, required=True)


def test_npy(spark, tmp_path):
    matrix = np.random.default_rng(0).normal(size=(1000, 5)).astype(np.float32)
    np.save(tmp_path / "m.npy", matrix)
    spark.dataSource.register(npy.NpyDataSource)
    df = spark.read.format("npy").option("rows", 300).load(str(tmp_path / "m.npy"))
    rows = df.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(1000)) and np.allclose([r.embedding for r in rows], matrix)
    assert npy.write_npy(df, str(tmp_path / "n.npy"), 5) == 1000 and (np.load(tmp_path / "n.npy") == matrix).all()
    np.save(tmp_path / "bad.npy", matrix.astype(np.float64))
    with pytest.raises(Exception, match="float64"):
        spark.read.format("npy").load(str(tmp_path / "bad.npy")).count()


def test_batching(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([5, 5, 5, 20, 1, 1, 1, 1])], "i int, n int")
    got = [r.batch for r in batching.batch_ids(df, "i", "n", 3, 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]
    assert batching.batch_ids(df, "i", "n", 3, 10).count() == 8


def test_requests(spark):
    rows = [("  linen wedding guest dress  ", None), ("ab", 5), ("abc", 21), ("abc", 0), (None, 8), ("x" * 501, 8), ("x" * 500, 20)]
    got = explain.validate_requests(spark.createDataFrame(rows, "query string, max_results int")).collect()
    assert (got[0].query, got[0].max_results, got[0].status) == ("linen wedding guest dress", 8, "ok")
    assert [r.status for r in got[1:]] == ["invalid_request"] * 5 + ["ok"]


def test_explanations(spark):
    ranked = spark.createDataFrame([(q, r) for q in range(6) for r in (1, 3)], "q int, rank int")
    said = [
        (0, 1, "  Matches the beach need.\n", 0), (0, 3, "b", 1), (1, 1, "a", 0), (1, 99, "b", 1), (2, 1, "a", 0), (2, 3, "b", 1), (2, 3, " ", 2),
        (3, 1, "a", 0), (3, 3, " ", 1), (4, 3, " ", 0), (4, 3, "b", 1), (4, 1, "a", 2),
    ]
    merged, verdicts = explain.merge_explanations(ranked, spark.createDataFrame(said, "q int, rank int, why_this_matches string, place int"), ["q"])
    assert {r.q: r.verdict for r in verdicts.collect()} == {0: "ok", 1: "rank_mismatch", 2: "duplicate_rank", 3: "rank_mismatch", 4: "ok", 5: "rank_mismatch"}
    got = {(r.q, r.rank): r.why_this_matches for r in merged.collect()}
    assert got == {(0, 1): "Matches the beach need.", (0, 3): "b", (4, 1): "a", (4, 3): "b"}
