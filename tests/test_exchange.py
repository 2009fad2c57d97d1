"""Files in and out, row numbers, and the cost of vector functions and search."""

import gzip
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import search
from quern.sources import files, npy, shared


def test_npy_rows_go_to_their_places(spark, tmp_path):
    matrix = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    rows = [(i * 7 - 40, row.tolist()) for i, row in enumerate(matrix)]
    df = spark.createDataFrame(rows, "row_index bigint, embedding array<float>").repartition(5)
    assert npy.write_npy(df, str(tmp_path / "sparse.npy"), 3) == 500
    assert (np.load(tmp_path / "sparse.npy") == matrix).all() and not (tmp_path / "sparse.npy.partial").exists()
    assert npy.write_npy(df.limit(0), str(tmp_path / "none.npy"), 3) == 0 and np.load(tmp_path / "none.npy").shape == (0, 3)


def test_ranks_have_no_gaps(spark):
    df = spark.createDataFrame([(i * i,) for i in range(300)], "line bigint").repartition(4)
    got = {r.line: r.at for r in files.renumbered(df, "line", "at", block=100).collect()}
    assert got == {i * i: i for i in range(300)}


def test_gzipped_lines_are_dealt_out(spark, tmp_path):
    with gzip.open(tmp_path / "raw.jsonl.gz", "wt") as f:
        f.write("\n".join(f'{{"i": {i}}}' for i in range(400)) + "\n")
    lines = files.indexed_lines(spark, str(tmp_path / "raw.jsonl.gz"))
    sizes = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert {r.row_index: json.loads(r.value)["i"] for r in lines.collect()} == {i: i for i in range(400)}


def test_typed_lines_name_the_bad_one(spark, tmp_path):
    good = {"parent_asin": "A", "title": "t", "average_rating": 4.5, "rating_number": 10, "features": ["x"]}
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"parent_asin": "B"}) + "\n")
    assert [r.parent_asin for r in files.read_products(spark, str(path)).collect()] == ["A", "B"]
    path.write_text(json.dumps(good) + '\n{"rating_number": "many"}\n')
    with pytest.raises(Exception, match="line 2 is no product"):
        files.read_products(spark, str(path)).collect()
    path.write_text("\n")
    with pytest.raises(ValueError, match="no products"):
        files.read_products(spark, str(path))


def test_products_keep_their_order(spark, tmp_path):
    cols = files.PRODUCT_COLUMNS
    df = spark.range(200).select(F.col("id").alias("row_index"), *[F.lit(None).cast("string").alias(c) if c != "parent_asin" else F.col("id").cast("string").alias(c) for c in cols])
    files.write_products(df.repartition(7), str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [int(x["parent_asin"]) for x in lines] == list(range(200)) and list(lines[0]) == list(cols)


def test_settings_of_a_file(tmp_path):
    (tmp_path / ".env").write_text("# keys\n\nexport OPENAI_API_KEY = 'abc'\nOTHER=1\n")
    path = str(tmp_path / ".env")
    assert files.settings({}, path=path)["api_key"] == "abc" and files.settings({"OPENAI_API_KEY": "x"}, path=path)["api_key"] == "x"
    assert files.settings({"OPENAI_API_KEY": " "}, path=path)["api_key"] == "abc" and files.settings({}, path=f"{path}.none")["api_key"] is None


def test_small_files_are_replaced_whole(spark, tmp_path):
    at = str(tmp_path / "sub" / "c.json")
    assert shared.read_json(spark, at) is None
    for value in ({"a": 1}, {"a": 2, "b": None}):
        shared.write_json(spark, value, at)
        assert shared.read_json(spark, at) == value
    assert len(list((tmp_path / "sub").glob("*.json"))) == 1
    with pytest.raises(FileExistsError):
        shared.rename(spark, at, at)


def test_normalising_is_linear_in_the_dimension(spark):
    def seconds(d):
        df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: (i + F.col("id")).cast("float")).alias("v"))
        df.select(F.sum(F.element_at(V.l2_normalize(F.col("v")), 1))).collect()
        began = time.perf_counter()
        df.select(F.sum(F.element_at(V.l2_normalize(F.col("v")), 1))).collect()
        return time.perf_counter() - began

    assert seconds(1536) < 20
    one = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([float("nan")],), (None,)], "v array<float>")
    got = [r[0] for r in one.select(V.l2_normalize(F.col("v"))).collect()]
    assert got[0] == [0.6, 0.8] and got[1:] == [None] * 4


def test_search_in_passes_and_tiles_agrees(spark, monkeypatch):
    rng = np.random.default_rng(2)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))], "k bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 16)))], "query_id bigint, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "k", "score", "place").collect()))
    want = rows(search.batch_candidates(corpus, queries, 7, "k"))
    for query_bytes in (16 * 8 * 9, 16 * 8 * 40, 1 << 30):
        assert rows(search.blocked_candidates(corpus, queries, 7, "k", query_bytes=query_bytes)) == want
    assert rows(search.batch_candidates(corpus, queries, 7, "k", query_bytes=16 * 8 * 9)) == want
    monkeypatch.setattr(search, "ROW_BYTES", 8 * 16 * 5)
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 5 * 3)
    assert rows(search.batch_candidates(corpus, queries, 7, "k")) == want
    v, q = np.array([r.embedding for r in corpus.orderBy("k").collect()]), np.array([r.embedding for r in queries.orderBy("query_id").collect()])
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ v.T, 6)
    assert [r[1] for r in want if r[0] == 3] == sorted(np.argsort(-scores[3], kind="stable")[:7].tolist())
    one = search.top_candidates(corpus, search.unit(q[3].tolist()), 7, "k")
    assert [r.k for r in one.collect()] == np.argsort(-scores[3], kind="stable")[:7].tolist()
    assert len(one._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_numbers_are_written_as_the_double_is(spark):
    import random

    from quern.functions.numbers import fixed

    rng = random.Random(3)
    values = [0.0, -0.0, 0.25, 0.35, 4.35, 2.675, 1.005, 0.5, 1.5, 2.5, -2.675, 99.995, 1e12, 123456789.125, 0.049999999999999996]
    values += [rng.uniform(-1e4, 1e4) for _ in range(500)] + [round(rng.uniform(0, 100), 3) for _ in range(1500)] + [rng.randint(0, 10**6) / 8 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    for digits in (0, 1, 2):
        got = {r.i: r.s for r in df.select("i", fixed(F.col("v"), digits).alias("s")).collect()}
        assert got.pop(-1) is None
        assert [got[i] for i in range(len(values))] == [f"{v:.{digits}f}" for v in values]


def test_token_counts_are_the_tokenizer_s(spark):
    path = "/opt/tokenizers/word_bpe_49k.json"
    tokenizers = pytest.importorskip("tokenizers")
    from quern.operators import embed_job
    from quern.operators.tokens import token_counts

    tool = tokenizers.Tokenizer.from_file(path)
    texts = ["", "one two", "Hello, world! " * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_index int, text string")
    counts = token_counts(df, "row_index", "text", path)
    want = [len(tool.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert {r.row_index: r.tokens for r in counts.collect()} == dict(enumerate(want))
    rows = embed_job.requests(df.join(counts, "row_index").coalesce(1), "row_index", 10, 50, lambda part: ([[1.0]] * len(part), [0, 0])).collect()
    assert {r.row_index: r.estimated_tokens for r in rows} == dict(enumerate(want)) and len({r.request for r in rows}) > 1


def test_request_files_are_answered_once(spark, tmp_path):
    from quern.operators.explain import validate_requests
    from quern.streaming.ingest import stream_requests

    asked, out = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()
    for i, n in enumerate((1, 1, 2)):
        if i != 1:
            (asked / f"{i}.json").write_text('{"query_id": %d, "query": "red dress", "max_results": 3}\n{"query_id": 9, "query": "x"}\n' % i)
        query = stream_requests(spark, str(asked), str(tmp_path / "log"), validate_requests, out)
        query.awaitTermination(60)
        assert sorted(r.status for r in spark.read.parquet(out).collect()) == ["invalid_request"] * n + ["ok"] * n
