"""Why products are rejected: every rule by its name, and the ingest's own status beside it."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.operators import ingest as I
from quern.plans import catalog as C

SF = "/root/testdata/sf0.01"
#: What the query has returned in its two former forms: the reasons alone, and the statuses alone.
REASONS = """CASE WHEN product_id % 11 = 0 THEN 'no_title' WHEN product_id % 7 = 0 THEN 'no_image' WHEN NOT coalesce(rating_number >= 30, false) THEN 'few_ratings'
  WHEN NOT coalesce(average_rating >= 4.0, false) THEN 'low_rating' ELSE 'ok' END"""
STATUSES = """CASE WHEN product_id % 11 = 0 OR product_id % 7 = 0 OR NOT (coalesce(rating_number >= 10, false) AND coalesce(average_rating >= 4.0, false)) THEN 'ineligible'
  WHEN product_id % 13 = 0 THEN 'missing_key' ELSE 'ok' END"""


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_both_former_results_are_sums_of_this_one(spark, duck):
    rows = entry.queries()["reject_reasons"](spark, SF).collect()
    for column, rule in (("reason", REASONS), ("status", STATUSES)):
        got = Counter()
        for r in rows:
            got[r[column]] += r.n
        assert got == dict(duck.execute(f"WITH {C.PRODUCTS_SQL} SELECT {rule}, count(*) FROM products GROUP BY 1").fetchall())
    assert {r.reason for r in rows} == {"no_title", "no_image", "few_ratings", "low_rating", "ok"} and {r.status for r in rows} == {"ineligible", "missing_key", "ok"}


def test_the_first_rule_that_fails_is_named(spark):
    good = (True, True, True, 10, 4.0)
    rows = [(good, None), ((*good[:4], float("nan")), None), ((False, False, True, 0, None), "no_title"), ((None, *good[1:]), "no_title"), ((True, False, None, 10, 4.0), "no_image")]
    rows += [((True, True, None, 1, 4.0), "no_features"), ((*good[:3], 9, 1.0), "few_ratings"), ((*good[:3], None, 4.0), "few_ratings"), ((*good[:4], None), "low_rating"), ((*good[:4], 3.9), "low_rating")]
    df = spark.createDataFrame([(i, *row, want) for i, (row, want) in enumerate(rows)], "i int, a boolean, b boolean, c boolean, n bigint, v double, want string")
    given = [F.col(c) for c in "abcnv"]
    got = df.select("i", "want", I.reason_column(*given).alias("reason"), I.reason_column(*given, min_count=11).alias("more"), I.eligible_column(*given).alias("eligible")).orderBy("i").collect()
    assert [r.reason for r in got] == [r.want for r in got] and [r.eligible for r in got] == [r.want is None for r in got]
    assert got[0].more == "few_ratings"
