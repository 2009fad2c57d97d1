"""Fill-in-the-middle: cuts against a plain regular expression, chunk edges, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string"


def plain(doc_id, text, p=M.FimParams()):
    """(n, form, prefix, middle, suffix, output) of one text, by list slices."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digits = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    if not text or h[2] % 100 >= p.fim_percent or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, None, text
    if h[3] % 100 < p.spm_percent:
        return n, "spm", len(pre), len(mid), len(suf), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), len(suf), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(seed, n, longest=60):
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", " ", "\t", "\n", "\r", "\x0b", "é", "日", "🙂", "\xa0", " ", "<", ">", "P", "S", "M", "\0"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 14])
def test_chunks_of_any_size_cut_alike(chunk):
    p = M.FimParams(chunk=chunk, group=5, fim_percent=100)
    given = texts(chunk, 300) + ["", " ", "a", "é", " \n", "a ", " a", "<P>", "x" * 40, " " * 40]
    h = np.array([[int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in range(len(given))])
    got = list(M.transformed([t.encode() for t in given], h, p))
    for i, (t, (*rest, output)) in enumerate(zip(given, got, strict=True)):
        assert (*rest, output.decode()) == plain(i, t, p), (i, t)


def test_every_rank_is_found_in_its_chunk_alone(monkeypatch):
    p = M.FimParams(chunk=4, group=2)
    for text in texts(9, 40):
        data = text.encode()
        found = M.Chunks(np.frombuffer(data + b" ", np.uint8), np.array([0]), np.array([len(data)]), p)
        tokens = TOKEN.findall(text)
        assert found.tokens().tolist() == [len(tokens)]
        seen = []
        monkeypatch.setattr(M, "ends_in", lambda b, f=M.ends_in: seen.append(len(b)) or f(b))
        for rank in range(len(tokens) + 1):
            before = "".join(tokens[:rank])
            assert found.cut(0, rank, len(tokens)) == (len(before.encode()), len(before))
        monkeypatch.undo()
        assert all(n <= p.chunk + 1 for n in seen)


def test_against_plain_code_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in M.report(docs).collect()}
    assert len(got) == len(rows)
    forms = set()
    for r in rows:
        n, form, pre, mid, suf, output = plain(r.doc_id, r.text)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.suffix_chars) == (n, form, pre, mid, suf)
        assert g.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    rows = [(None, "a b c d e", 1, "x"), (1, None, 2, "y"), (2, "", 3, "z"), (2, "", 3, "z"), (3, "one two <M> three", 4, None), (7, "wort " * 300_000 + "é", 5, "l"), (7, "wort " * 300_000 + "é", 5, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `n` int, `fim` string")
    got = M.transform(docs)
    assert got.columns == ["doc_id", "text", "n", "fim"]
    found = got.select("doc_id", "text", "n", F.col("fim.output").alias("o"), F.col("fim.n").alias("tokens"), F.col("fim.form").alias("f")).collect()
    assert len(found) == len(rows)
    for r in found:
        n, form, *_, output = plain(r.doc_id, r.text)
        assert (r.tokens, r.f, r.o) == (n, form, output)
    back = got.select("text", M.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert M.report(docs.limit(0)).count() == 0
    assert {f.name: f.dataType.simpleString() for f in M.report(docs).schema}["prefix_chars"] == "bigint"


def test_nothing_is_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = M.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
