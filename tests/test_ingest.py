"""Ingest: polymorphic JSON, eligibility, rejects."""

import json

from quern.operators import ingest
from quern.sources import files

GOOD = {
    "parent_asin": "A1", "title": " Red Dress ", "store": " S ", "average_rating": 4.5, "rating_number": 12, "price": 9.5, "images": [{"large": "https://i/1"}],
    "features": [" f1 ", "", 5, None, "f2"], "details": {"Style": " x ", "Other": "no", "Material": 3},
}


def row(**changes):
    return json.dumps({**GOOD, **changes})


CASES = [
    (row(), "ok"), (row(title=5), "ineligible"), (row(title=" "), "ineligible"), (row(images=[]), "ineligible"), (row(images={"large": ["x"]}), "ineligible"),
    (row(images=[None]), "ok"), (row(features=[" "]), "ok"), (row(features=None), "ineligible"), (row(rating_number="12"), "ok"), (row(rating_number=10.9), "ok"),
    (row(rating_number=9.9), "ineligible"), (row(rating_number="abc"), "ineligible"), (row(rating_number=None), "ineligible"), (row(rating_number=True), "ineligible"),
    (row(average_rating="4.0"), "ok"), (row(average_rating=3.99), "ineligible"), (row(average_rating="NaN"), "ok"), (row(parent_asin=" "), "missing_key"), (row(parent_asin=7), "missing_key"),
    (row(price="None"), "ok"), (row(images=[{"large": "nope"}]), "ok"), ("{broken", "malformed"), ("", "malformed"), (row(average_rating=1, parent_asin=None), "ineligible"),
]


def silvered(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "row_index int, value string")
    return ingest.silver(ingest.bronze(df))


def test_statuses(spark):
    got = {r.row_index: r.status for r in silvered(spark).collect()}
    assert [got[i] for i in range(len(CASES))] == [s for _, s in CASES]


def test_record(spark):
    rows = {r.row_index: r for r in silvered(spark).collect()}
    r = rows[0]
    assert (r.title, r.store, r.average_rating, r.rating_number, r.price, r.image_url) == ("Red Dress", "S", 4.5, 12, 9.5, "https://i/1")
    assert r.features == ["f1", "f2"] and r.normalized_title == "red dress" and r.retrieval_text == "Red Dress\n- f1\n- f2\nStore: S\nStyle: x"
    assert rows[9].rating_number == 10 and rows[19].price is None
    assert rows[20].image_url is None and rows[20].image_dropped and not rows[0].image_dropped


def test_reject_counts(spark):
    got = {r.reason: r.n for r in ingest.reject_counts(silvered(spark)).collect()}
    want = {}
    for _, s in CASES:
        want[s] = want.get(s, 0) + 1
    assert got == want | {"dropped_image_url": 1}


def test_files_round_trip(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "raw.jsonl.gz", "wt") as f:
        f.write("\n".join(v for v, _ in CASES[:6]))
    raw = files.indexed(files.raw_lines(spark, str(tmp_path / "raw.jsonl.gz")))
    out = ingest.products(ingest.silver(ingest.bronze(raw)))
    files.write_products(out, str(tmp_path / "products"))
    back = files.read_products(spark, str(tmp_path / "products"))
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))
    assert '"price":9.5' in "".join(p.read_text() for p in (tmp_path / "products").glob("part*"))


def test_indexed_places_have_no_gaps(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(997)], "value string").repartitionByRange(7, "value")
    rows = files.indexed(df).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(997)) and [r.value for r in rows] == sorted(r.value for r in rows)
