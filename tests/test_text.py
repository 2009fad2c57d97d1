"""Text functions against Python's own semantics."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T

TEXTS = [None, "", "  ", " a ", "\x1ca\x1f", " x y ", "a\t\n b", "​z", "Women's (Red) Dress, Size XL 2.5 x-large", "small ś 3² L10 10L 7", "M&M l", "İstanbul ÉTÉ 12.50.3"]


def one(spark, column, values=TEXTS):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_strip_and_blank(spark):
    assert one(spark, T.strip("t")) == [t if t is None else t.strip() for t in TEXTS]
    assert one(spark, T.blank_to_null("t")) == [None if t is None else t.strip() or None for t in TEXTS]
    assert one(spark, T.has_text("t")) == [bool(t and t.strip()) for t in TEXTS]
    assert one(spark, T.collapse_spaces("t")) == [None if t is None else " ".join(t.split()) for t in TEXTS]


TITLES = {
    "": "", "  ": "", "Women's (Red) Dress, Size XL 2.5 x-large": "women dress", "M&M l": "", "Dress 12.50.3": "dress", "a (b (c) d) e": "a d e", "size-small/xl": "",
    "x_s s_x": "x s s x", "1.5.2 3.a": "a", "Tee (pack of 2) 3 L10 10L": "tee l10 10l", "\tBig   HAT\n": "big hat", "one two three four five six seven eight nine ten eleven twelve thirteen": "one two three four five six seven eight nine ten eleven twelve",
    "(all gone)": "", "open (never closed": "open never closed", "medium-weight XXL coat": "weight coat", "Étoile scarf": "toile scarf",
}


def test_titles(spark):
    assert dict(zip(TITLES, one(spark, T.normalize_title("t"), list(TITLES)), strict=True)) == TITLES


def test_categories(spark):
    got = one(spark, T.categories("t"), ["Women's shoes for men", "women, dress", "WATCH", None, ""])
    assert got == [["women", "men", "shoes"], ["dresses"], ["accessories"], ["uncategorized"], ["uncategorized"]]


def test_retrieval_text(spark):
    c = T.retrieval_text(F.col("t"), F.array(F.lit(" f "), F.lit(" "), F.lit(None)), F.lit(" s "), [("Style", F.lit(" x ")), ("Material", F.lit(" "))])
    assert one(spark, c, [" title ", None]) == ["title\n- f\nStore: s\nStyle: x", "- f\nStore: s\nStyle: x"]


@pytest.mark.parametrize(("text", "n"), [("", 1), ("a", 1), ("abcd", 2), ("a" * 300, 100)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate("t"), [text]) == [n]


def test_urls(spark):
    urls = ["https://a/b", "HTTP://x", "ftp://x", "https://", "https:///a", "not", None, "https://a b"]
    assert one(spark, T.is_http_url("t"), urls) == [True, True, False, False, False, False, False, False]
