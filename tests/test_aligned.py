"""Product lines and matrix rows, zipped by place: what is aligned loads, and what is shifted raises."""

import json

import numpy as np
import pytest

from quern import providers as M
from quern.operators import embed_job
from quern.pipeline import load_aligned
from quern.sources import files, npy


def product(i):
    row = dict.fromkeys(("store", "average_rating", "rating_number", "price", "image_url"))
    return row | {"parent_asin": f"A{i}", "title": f"title {i}", "features": [], "normalized_title": f"title {i}", "retrieval_text": f" words {i} of {i % 7} "}


@pytest.fixture
def built(spark, tmp_path):
    """Lines in several files of unequal size, and what the embedding job made of them."""
    (tmp_path / "lines").mkdir()
    for name, a, b in (("part-0", 0, 5), ("part-1", 5, 80), ("part-2", 80, 81), ("part-3", 81, 120)):
        (tmp_path / "lines" / f"{name}.json").write_text("".join(json.dumps(product(i)) + "\n" for i in range(a, b)))
    lines = str(tmp_path / "lines")
    texts = files.product_texts(files.placed_products(spark, lines))
    manifest = embed_job.run(spark, texts, M.HashEmbedder(8), str(tmp_path / "v"), log=lambda line: None)
    npy.write_npy(spark.read.parquet(str(tmp_path / "v")), str(tmp_path / "m.npy"), 8)
    return lines, str(tmp_path / "m.npy"), manifest


def test_aligned_files_are_zipped_without_a_shuffle(spark, built):
    lines, matrix, manifest = built
    found = load_aligned(spark, *built)
    rows = found.collect()
    assert [(r.row_index, r.parent_asin) for r in sorted(rows, key=lambda r: r.row_index)] == [(i, f"A{i}") for i in range(120)]
    want = np.load(matrix)
    assert all(np.array_equal(np.array(r.embedding, np.float32), want[r.row_index]) for r in rows)
    for r in rows[:20]:
        assert np.allclose(r.embedding, M.checked_rows(M.HashEmbedder(8).embed([r.retrieval_text.strip()]), 1, 8)[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The splits' counts are exchanged, the lines are not.
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1


@pytest.mark.parametrize("change", ["a row less", "rows shifted", "two rows swapped", "a line moved", "a line changed", "a row scaled", "a blank line"])
def test_what_is_not_aligned_raises(spark, built, tmp_path, change):
    lines, matrix, manifest = built
    m = np.load(matrix)
    path = tmp_path / "lines" / "part-1.json"
    text = path.read_text().splitlines(keepends=True)
    if change == "a row less":
        np.save(matrix, m[:-1])
    elif change == "rows shifted":
        np.save(matrix, np.roll(m, 1, axis=0))
    elif change == "two rows swapped":
        m[[50, 51]] = m[[51, 50]]
        np.save(matrix, m)
    elif change == "a row scaled":
        m[7] *= 1.5
        np.save(matrix, m)
    elif change == "a line moved":
        path.write_text("".join(text[1:] + text[:1]))
    elif change == "a line changed":
        path.write_text("".join([text[0].replace("words", "word"), *text[1:]]))
    else:
        path.write_text("".join(["\n", *text[1:]]))
    with pytest.raises(Exception, match="go together|not those that were embedded|not the vectors|not unit|is no product"):
        load_aligned(spark, lines, matrix, manifest).collect()


def test_lines_are_numbered_by_file_whatever_their_sizes(spark, built):
    got = files.in_file_order(spark, built[0]).orderBy("row_index").collect()
    assert [json.loads(r.value)["parent_asin"] for r in got] == [f"A{i}" for i in range(120)] and [r.row_index for r in got] == list(range(120))
    # Small splits of one file, too.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = files.in_file_order(spark, built[0]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_index, json.loads(r.value)["parent_asin"]) for r in got) == [(i, f"A{i}") for i in range(120)]
