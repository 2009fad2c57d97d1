"""Streams: batches that are stopped between their writes, and repeated, leave every row once."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from quern.operators.explain import validate_requests
from quern.sources import shared
from quern.streaming import ingest as S


def line(i, **more):
    return json.dumps({"parent_asin": f"A{i}", "title": f"title {i}", "store": "s", "average_rating": 4.5, "rating_number": 20, "features": ["soft"], "images": [{"large": f"https://x/{i}"}]} | more) + "\n"


def fill(folder, name, first, n):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line(i) for i in range(first, first + n)) + "{broken\n" + line(99, rating_number=1))


@pytest.fixture
def args(spark, tmp_path):
    fill(tmp_path / "lines", "a.jsonl", 0, 5)
    return (spark, str(tmp_path / "lines"), str(tmp_path / "products"), str(tmp_path / "rejects"), str(tmp_path / "log"), str(tmp_path / "markers"))


def run(args):
    S.stream_products(*args).awaitTermination(120)


def keys(spark, args):
    found = S.committed(spark, args[2], args[5])
    return sorted(r.parent_asin for r in found.collect()) if found is not None else []


def rejects(spark, args):
    found = S.reject_totals(spark, args[3], args[5])
    return {r.reason: r.n for r in found.collect()} if found is not None else {}


@pytest.mark.parametrize("step", ["second write", "marker", "after marker"])
def test_a_batch_that_stops_is_repeated_in_place(spark, args, tmp_path, monkeypatch, step):
    run(args)
    first = [f"A{i}" for i in range(5)]
    assert keys(spark, args) == first and rejects(spark, args) == {"ok": 5, "malformed": 1, "ineligible": 1}
    fill(tmp_path / "lines", "b.jsonl", 10, 3)
    commit = S.commit_batch

    def stopped(batch, epoch, tables, markers):
        if step == "second write":
            commit(batch, epoch, dict(list(tables.items())[:1]), str(tmp_path / "elsewhere"))
        elif step == "marker":
            commit(batch, epoch, tables, str(tmp_path / "elsewhere"))
        else:
            commit(batch, epoch, tables, markers)
        raise RuntimeError("stop here")

    with monkeypatch.context() as m:
        m.setattr(S, "commit_batch", stopped)
        with pytest.raises(StreamingQueryException, match="stop here"):
            run(args)
    # The products of the second batch lie there, but are seen with its rejects or not at all.
    assert spark.read.parquet(args[2]).count() == 8
    both = sorted([*first, "A10", "A11", "A12"])
    assert keys(spark, args) == (both if step == "after marker" else first)
    for _ in range(2):
        run(args)
        assert keys(spark, args) == both and rejects(spark, args) == {"ok": 8, "malformed": 2, "ineligible": 2}
        assert spark.read.parquet(args[2]).count() == 8
    told = [shared.read_json(spark, f"{args[5]}/{name}") for name in shared.files(spark, args[5])]
    assert sorted(m["rows"][args[2]] for m in told) == [3, 5] and len({m["stream"] for m in told}) == 1


def test_a_new_checkpoint_replaces_nothing(spark, args, tmp_path):
    run(args)
    run((*args[:4], str(tmp_path / "log2"), args[5]))
    assert keys(spark, args) == sorted(2 * [f"A{i}" for i in range(5)])
    assert S.committed(spark, args[2], str(tmp_path / "none")) is None and S.reject_totals(spark, args[3], str(tmp_path / "none")) is None


def test_repeated_requests_are_answered_once(spark, tmp_path, monkeypatch):
    asked, out = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()
    (asked / "1.json").write_text('{"query_id": 1, "query": "red dress"}\n{"query_id": 2, "query": "x"}\n')
    go = lambda: S.stream_requests(spark, str(asked), str(tmp_path / "log"), validate_requests, out).awaitTermination(60)
    with monkeypatch.context() as m:
        m.setattr(shared, "write_json", lambda *a: (_ for _ in ()).throw(RuntimeError("stop here")))
        with pytest.raises(StreamingQueryException, match="stop here"):
            go()
    for _ in range(2):
        go()
        assert sorted((r.query_id, r.status) for r in S.committed(spark, out, f"{out}.markers").collect()) == [(1, "ok"), (2, "invalid_request")]
