"""The embedding job's requests, order, usage, resume and manifest."""

from dataclasses import dataclass

import numpy as np
import pytest

from quern import providers as M
from quern.operators import embed_job
from quern.sources import files, shared


def texts_of(spark, n, parts=3):
    return spark.createDataFrame([(i, f"text {i} " * (i % 5 + 1)) for i in range(n)], "row_index bigint, text string").repartition(parts)


class Reversed(M.HashEmbedder):
    """Answers in the reverse order, and counts what it uses."""

    def request(self, texts, timeout):
        assert timeout == 7.5
        rows = self.embed(texts)
        return M.Vectors([(i, rows[i]) for i in reversed(range(len(texts)))], len(texts), 10 * len(texts))


class Fickle(M.HashEmbedder):
    def embed(self, texts):
        if any("text 11 " in t for t in texts):
            raise M.ProviderError("stop")
        return super().embed(texts)


def test_answers_are_put_in_order(spark, tmp_path):
    texts, out = texts_of(spark, 40), str(tmp_path / "v")
    manifest = embed_job.run(spark, texts, Reversed(8), out, max_inputs=4, timeout=7.5, log=lambda line: None)
    got = {r.row_index: r.embedding for r in spark.read.parquet(out).collect()}
    plain = M.HashEmbedder(8)
    for i, text in ((r.row_index, r.text) for r in texts.collect()):
        assert np.allclose(got[i], M.checked_rows(plain.embed([text]), 1, 8)[0])
    assert (manifest["prompt_tokens"], manifest["total_tokens"]) == (40, 400)
    for rows in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (2, [1.0])]):
        with pytest.raises(M.ProviderError):
            M.in_order(M.Vectors(rows), 2)


def test_requests_hold_their_limits(spark):
    texts = texts_of(spark, 100, 2)
    rows = embed_job.embedded(texts, M.HashEmbedder(4), "row_index", max_inputs=7, max_tokens=30).collect()
    assert sorted(r.row_index for r in rows) == list(range(100))
    single = embed_job.embedded(texts.coalesce(1), M.HashEmbedder(4), "row_index", max_inputs=7, max_tokens=30).collect()
    used = {}
    for r in single:
        used.setdefault(r.request, []).append(r.estimated_tokens)
    assert all(len(x) <= 7 and (sum(x) <= 30 or len(x) == 1) for x in used.values()) and len(used) > 14
    for a, b in zip(sorted(used), sorted(used)[1:], strict=False):
        assert len(used[a]) == 7 or sum(used[a]) + used[b][0] > 30
    with pytest.raises(ValueError):
        embed_job.embedded(texts, M.HashEmbedder(4), "row_index", max_tokens=300_001)


class RateLimitError(Exception):
    """By its name a failure that passes."""


@dataclass(frozen=True)
class Told(M.HashEmbedder):
    """Writes every text it is asked for to a file, and fails on the texts named in another."""

    folder: str = ""
    passing: bool = False

    def embed(self, texts):
        with open(f"{self.folder}/asked", "a") as f:
            f.write("".join(f"{t.split()[1]}\n" for t in texts))
        bad = open(f"{self.folder}/bad").read().split()
        if any(t.split()[1] in bad for t in texts):
            raise RateLimitError("stop") if self.passing else M.ProviderError("stop")
        return super().embed(texts)


def asked(folder):
    path = folder / "asked"
    found = [int(x) for x in path.read_text().split()] if path.exists() else []
    path.write_text("")
    return found


@pytest.fixture
def told(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "backoff", lambda attempt: 0)
    (tmp_path / "bad").write_text("")
    return tmp_path


def test_a_run_stopped_in_its_last_wave_keeps_the_others(spark, told):
    texts, out, lines = texts_of(spark, 40, 4), str(told / "v"), []
    go = lambda **more: embed_job.run(spark, texts, Told(8, folder=str(told)), out, max_inputs=5, min_waves=4, log=lines.append, **more)
    at = embed_job.paths_of(out)
    last = {r.row_index for r in spark.createDataFrame(texts.rdd.mapPartitionsWithIndex(lambda i, rows: [(r.row_index,) for r in rows if i == 3]), "row_index bigint").collect()}
    bad = min(last)
    (told / "bad").write_text(str(bad))
    with pytest.raises(embed_job.EmbeddingFailed, match="1 rows of wave 3 have no vector .ProviderError: stop.; 39 of 40"):
        go()
    assert not shared.exists(spark, out) and len(embed_job.committed_waves(spark, at["staging"])) == 4
    assert shared.read_json(spark, at["checkpoint"])["waves"] == [0, 1, 2, 3]
    assert [line.split(":")[0] for line in lines] == [f"wave {i} of 4" for i in (1, 2, 3, 4)] and "39 of 40 rows (97.5%)" in lines[-1]
    assert set(asked(told)) == set(range(40))
    (told / "bad").write_text("")
    manifest = go()
    assert asked(told) == [bad] and manifest["product_count"] == 40
    rows = spark.read.parquet(out)
    assert rows.select("row_index").distinct().count() == rows.count() == 40 and {r.wave for r in rows.select("wave").distinct().collect()} == {0, 1, 2, 3, 4}
    for name in ("staging", "pending", "checkpoint"):
        assert not shared.exists(spark, at[name])
    assert go()["output_sha256"] == manifest["output_sha256"] and asked(told) == []


def test_a_provider_that_is_down_is_not_asked_by_the_rest_of_the_task(spark, told, monkeypatch):
    texts, out = texts_of(spark, 60, 1), str(told / "v")
    first = texts.first().row_index
    (told / "bad").write_text(str(first))
    with pytest.raises(embed_job.EmbeddingFailed, match="60 rows of wave 0"):
        embed_job.run(spark, texts, Told(8, folder=str(told), passing=True), out, max_inputs=5, log=lambda line: None)
    assert len(set(asked(told))) == 5
    (told / "bad").write_text("")
    embed_job.run(spark, texts, Told(8, folder=str(told), passing=True), out, max_inputs=5, log=lambda line: None)
    assert sorted(asked(told)) == list(range(60))


@pytest.mark.parametrize("step", ["wave", "checkpoint", "check", "rename", "hash", "manifest"])
def test_a_stop_at_any_step_loses_and_repeats_nothing(spark, told, monkeypatch, step):
    texts, out = texts_of(spark, 24, 4), str(told / "v")
    go = lambda: embed_job.run(spark, texts, Told(8, folder=str(told)), out, max_inputs=3, min_waves=2, log=lambda line: None)
    embed_job.run(spark, texts.filter("row_index < 4"), Told(8, folder=str(told)), out, max_inputs=3, log=lambda line: None)
    old = {(r.row_index, r.run) for r in spark.read.parquet(out).collect()}
    assert sorted(asked(told)) == [0, 1, 2, 3]

    def stop(*a, **k):
        raise RuntimeError("stop here")

    write, seen = shared.write_json, []

    def stop_at_second(spark, value, path):
        seen.append(path)
        return write(spark, value, path) if len(seen) < 3 or path.endswith("manifest.json") else stop()

    with monkeypatch.context() as m:
        if step == "wave":
            m.setattr(embed_job, "embedded", stop)
        elif step == "checkpoint":
            m.setattr(shared, "write_json", stop_at_second)
        elif step == "manifest":
            m.setattr(shared, "write_json", lambda s, v, p: stop() if p.endswith("manifest.json") else write(s, v, p))
        else:
            m.setattr(*{"check": (embed_job, "check_whole"), "rename": (shared, "rename"), "hash": (shared, "tree_hash")}[step], stop)
        with pytest.raises(RuntimeError, match="stop here"):
            go()
    # The output is the old one, or the new one whole.
    now = {(r.row_index, r.run) for r in spark.read.parquet(out).collect()}
    assert now in (old, old | {(i, 2) for i in range(4, 24)})
    before = asked(told)
    go()
    after = asked(told)
    assert sorted(before + after) == list(range(4, 24))
    assert {(r.row_index, r.run) for r in spark.read.parquet(out).collect()} == old | {(i, 2) for i in range(4, 24)}
    assert shared.read_json(spark, embed_job.paths_of(out)["manifest"])["product_count"] == 24


def test_what_is_not_whole_is_never_published(spark, told):
    texts, out = texts_of(spark, 10), str(told / "v")
    twice = texts.unionByName(texts.limit(1))
    with pytest.raises(ValueError, match="not whole"):
        embed_job.run(spark, twice, Told(8, folder=str(told)), out, log=lambda line: None)
    assert not shared.exists(spark, out)

    wrong = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0])], "row_index bigint, embedding array<float>")
    with pytest.raises(ValueError, match="not unit vectors"):
        embed_job.check_whole(wrong, "row_index", 2, 2, "here")
    with pytest.raises(ValueError, match="not unit vectors"):
        embed_job.check_whole(wrong.limit(1), "row_index", 3, 1, "here")
    with pytest.raises(ValueError, match="not whole"):
        embed_job.check_whole(wrong.limit(1), "row_index", 2, 2, "here")


def test_a_wave_that_did_not_commit_is_made_again(spark, told):
    texts, out = texts_of(spark, 20, 4), str(told / "v")
    at = embed_job.paths_of(out)
    (told / "bad").write_text("3")
    with pytest.raises(embed_job.EmbeddingFailed):
        embed_job.run(spark, texts, Told(8, folder=str(told)), out, min_waves=4, log=lambda line: None)
    asked(told)
    whole = embed_job.committed_waves(spark, at["staging"])
    lost = {r.row_index for r in spark.read.parquet(f"{at['staging']}/wave={whole[0]}").collect()}
    shared.delete(spark, f"{at['staging']}/wave={whole[0]}/_SUCCESS")
    (told / "bad").write_text("")
    embed_job.run(spark, texts, Told(8, folder=str(told)), out, min_waves=4, log=lambda line: None)
    assert lost <= set(asked(told)) and spark.read.parquet(out).select("row_index").distinct().count() == spark.read.parquet(out).count() == 20


def test_another_run_cannot_go_on(spark, told):
    texts, out = texts_of(spark, 30, 6), str(told / "v")
    source = told / "in"
    source.write_text("one")
    run = lambda embedder, **more: embed_job.run(spark, texts, embedder, out, log=lambda line: None, input_path=f"file://{source}", **more)
    with pytest.raises(Exception, match="stop"):
        run(Fickle(8), max_inputs=2)
    at = embed_job.paths_of(out)
    assert shared.read_json(spark, at["checkpoint"])["product_count"] == 30 and not shared.exists(spark, out)
    for embedder, more in ((M.HashEmbedder(8), {"max_inputs": 3}), (M.HashEmbedder(8, "another"), {"max_inputs": 2}), (M.HashEmbedder(8), {"max_inputs": 2, "timeout": 5.0})):
        with pytest.raises(ValueError, match="another run"):
            run(embedder, **more)
    source.write_text("two")  # one changed file, as long as before
    with pytest.raises(ValueError, match="input_sha256 differ"):
        run(M.HashEmbedder(8), max_inputs=2)
    source.write_text("one")
    manifest = run(M.HashEmbedder(8), max_inputs=2)
    assert manifest["product_count"] == 30 and not shared.exists(spark, at["checkpoint"]) and not shared.exists(spark, at["staging"])
    assert manifest["input_sha256"] == shared.tree_hash(spark, str(source))["sha256"] and manifest["output_sha256"] == shared.tree_hash(spark, out)["sha256"]
    assert spark.read.parquet(out).select("row_index").distinct().count() == 30
    with pytest.raises(ValueError, match="31 rows"):
        embed_job.check_checkpoint({}, {}, 31, 30)


def test_an_empty_input(spark, tmp_path):
    out = str(tmp_path / "v")
    manifest = embed_job.run(spark, texts_of(spark, 3).limit(0), M.HashEmbedder(8), out, log=lambda line: None)
    assert manifest["product_count"] == 0 and spark.read.parquet(out).count() == 0


def test_planned_requests_are_those_of_one_pass(spark):
    from quern.operators.batching import NextFit

    texts = texts_of(spark, 300, 5)
    serve = lambda part: ([[1.0]] * len(part), [len(part), 0])
    rows = sorted(embed_job.requests(embed_job.planned(texts, "row_index", 7, 30), "row_index", 7, 30, serve).collect(), key=lambda r: r.row_index)
    fit = NextFit(7, 30)
    assert [r.request for r in rows] == [fit.place(r.estimated_tokens) for r in rows]
    used = {}
    for r in rows:
        used.setdefault(r.request, []).append(r.prompt_tokens)
    assert all(n == [len(n)] + [0] * (len(n) - 1) for n in used.values())


def test_the_manifest_says_what_was_made(spark, tmp_path):
    texts = texts_of(spark, 20)
    one = embed_job.run(spark, texts, M.HashEmbedder(8), str(tmp_path / "a"), input_path="in.jsonl", limit=20, log=lambda line: None)
    two = embed_job.run(spark, texts.repartition(1), M.HashEmbedder(8), str(tmp_path / "b"), input_path="in.jsonl", limit=20, log=lambda line: None)
    assert one["vectors_digest"] == two["vectors_digest"] and one["texts_digest"] == two["texts_digest"]
    assert (one["input_path"], one["limit"], one["max_inputs_per_request"], one["request_timeout_seconds"]) == ("in.jsonl", 20, 256, 60.0)
    files.check_manifest(one, 20, 8)
    other = embed_job.run(spark, texts.filter("row_index > 0"), M.HashEmbedder(8), str(tmp_path / "c"), log=lambda line: None)
    assert other["vectors_digest"] != one["vectors_digest"]
    with pytest.raises(ValueError, match="output of its own"):
        embed_job.check_output(embed_job.DEFAULT_OUTPUT, 5)
    embed_job.check_output(embed_job.DEFAULT_OUTPUT, None)
