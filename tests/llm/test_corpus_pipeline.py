"""The pipeline on a small corpus, stage by stage against plain code."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from quern.llm import line_dedup, quality_rules
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_ngram_jaccard import brute
from tests.llm.test_source_mixing import plain_targets

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(12)
    plate = "all rights reserved by the owners of this site"
    rows = []
    for i in range(240):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.choice([5, 30, 80, 200]))]
        text = " ".join(words)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1].replace("w1", "v1", 1)
        if rng.random() < 0.5:
            text += "\n" + plate
        if rng.random() < 0.05:
            text = "spam and more spam " * 30
        rows.append((i, text, "en", f"s{rng.randint(0, 14)}"))
    rows += [(900, None, None, None), (901, plate, "en", "s3"), (902, "", "en", None)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(corpus(), DDL).repartition(3)
    out = []
    for name, stage in C.STAGES:
        made = stage(spark, docs, str(where))
        made.write.parquet(f"{where}/{name}")
        before, docs = docs, spark.read.parquet(f"{where}/{name}")
        out.append((before, docs))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_columns_are_those_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert after.filter("n_chars <> length(text)").count() == 0


def test_quality(stages):
    before, after = stages[0]
    kept = {i for i, text, _ in rows_of(before) if quality_rules.measure((text or "").encode(), quality_rules.QualityRules())[8]}
    assert {r[0] for r in rows_of(after)} == kept and len(kept) > 100


def test_lines(stages):
    before, after = stages[1]
    want = dict(plain_lines(rows_of(before), line_dedup.LineDedup().min_sites))
    had = {i: t for i, t, _ in rows_of(before)}
    assert {i: t for i, t, _ in rows_of(after)} == {i: t for i, t in want.items() if t == had[i] or t.split()}
    assert any(want[i] != had[i] for i in want)


def test_near_duplicates(stages):
    before, after = stages[2]
    want = {c for _, _, c in brute([(i, t) for i, t, _ in rows_of(before)])}
    assert {r[0] for r in rows_of(after)} == want and after.count() < before.count()


def test_mix(stages):
    before, after = stages[3]
    sizes, got = defaultdict(int), Counter()
    for _, text, source in rows_of(before):
        sizes[source] += len((text or "").split())
    for _, text, source in rows_of(after):
        got[source] += len(text.split())
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)


def test_pack(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows_of(before))
    rows = after.collect()
    assert sum(r.length for r in rows) == sum(n * k for n, k in lengths.items())
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_is_all_stages(spark, stages, tmp_path):
    spark.createDataFrame(corpus(), DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = C.run(spark, str(tmp_path))
    want = stages[-1][1]
    total = lambda df: (df.select("doc_id").distinct().count(), df.selectExpr("sum(length)").first()[0])
    assert total(got) == total(want)
