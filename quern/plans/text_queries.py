"""Queries over texts and JSON: titles, retrieval texts, features, images, properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ingest
from quern.plans import catalog as C


def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.col("p_name"), F.lit(" (Medium) Size "), F.col("p_size").cast("string"), F.lit(" XL 2.5"))
    return C.table(spark, sf_dir, "part").select("p_partkey", T.normalize_title(noisy).alias("title"))


def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = C.table(spark, sf_dir, "part")
    store = F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    features = F.array(F.concat(F.lit(" size "), F.col("p_size").cast("string")), F.lit(" "), F.col("p_type"))
    details = [("Style", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))), ("Material", F.lit(" steel "))]
    return part.select("p_partkey", T.retrieval_text(F.col("p_name"), features, store, details).alias("retrieval_text"))


def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.clean_list(T.first_lines("text"))
    return C.table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n"), F.array_join(lines, "\n").alias("features"))


def first_six_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.slice(T.clean_list(T.first_lines("text")), 1, 6)
    return C.table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("features"))


#: Lists of images as lines have them, and the address that each gives; # stands for the event.
IMAGES = (
    '[{"large": "L#", "hi_res": "H#", "thumb": "T#"}]', '[{"large": "", "hi_res": "H#"}]', '[{"large": null, "thumb": "T#"}, {"large": "X#"}]', "[{}, {\"large\": \"X#\"}]",
    '["text"]', "[null]", "[]", '{"large": ["L#"]}', "null", "{broken",
)
IMAGE_ANSWERS = ("L#", "H#", "T#", None, None, None, None, None, None, None)


def _k(props: str = "props") -> F.Column:
    return F.try_variant_get(F.try_parse_json(props), "$.k", "bigint")


def first_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all events, with a list of images by the number in their properties."""
    shape = F.element_at(F.array(*[F.lit(x) for x in IMAGES]), (_k() % len(IMAGES) + 1).cast("int"))
    text = F.replace(shape, F.lit("#"), F.col("event_id").cast("string"))
    images = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return C.table(spark, sf_dir, "events").select("event_id", ingest.first_image_url(images).alias("url"))


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with a name (blank for views) and a list, of one type or another, joined to them."""
    name = F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type"))
    listed = F.when(F.col("user_id") % 4 == 0, F.lit('"text"')).otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), (F.col("user_id") % 4).cast("int")), ","), F.lit("]")))
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "name": "'), name, F.lit('", "list": '), listed, F.lit("}"))
    v = F.try_parse_json(text)
    return C.table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), T.has_text(F.try_variant_get(v, "$.name", "string")).alias("has_name"),
        F.coalesce(F.size(F.try_variant_get(v, "$.list", "array<variant>")), F.lit(0)).alias("n_list"),
    )


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product lines made of parts: some malformed, some without key, image or rating."""
    k = F.col("product_id")
    image = F.when(k % 9 == 0, F.lit("not a url")).otherwise(F.concat(F.lit("https://img.example/"), k.cast("string")))
    record = F.struct(
        F.when(k % 10 != 0, F.concat(F.lit("P"), k.cast("string"))).alias("parent_asin"), F.concat(F.lit(" "), F.col("title"), F.lit(" ")).alias("title"), "store",
        F.col("average_rating").alias("average_rating"), F.col("rating_number").cast("string").alias("rating_number"), F.col("price").alias("price"),
        F.array(F.struct(image.alias("large"))).alias("images"), F.when(k % 8 != 0, F.array(F.lit("one"), F.lit(" "), F.lit(" two "))).alias("features"),
        F.struct(F.lit(" wool ").alias("Material"), F.lit("no").alias("Other")).alias("details"),
    )
    line = F.when(k % 17 == 0, F.lit("{broken")).otherwise(F.to_json(record))
    return C.products(spark, sf_dir).select(k.alias("row_index"), line.alias("value"))


def ingest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.products(ingest.silver(ingest.bronze(_lines(spark, sf_dir)))).withColumn("features", F.array_join("features", "|"))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reject_counts(ingest.silver(ingest.bronze(_lines(spark, sf_dir))))


_TRIM = r"regexp_replace({c}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_CLEAN = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIM.format(c='x')}), lambda x: x <> '')"
_NOISY = "p_name || ' (Medium) Size ' || p_size || ' XL 2.5'"
_IMAGE_LIST = ", ".join("NULL" if a is None else repr(a) for a in IMAGE_ANSWERS)
_PROPS = """(regexp_replace(props, '\\}\\s*$', '') || ', "name": "' || CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END || '", "list": '
  || CASE WHEN user_id % 4 = 0 THEN '"text"' ELSE '[' || array_to_string(list_transform(range(user_id % 4), lambda i: '1'), ',') || ']' END || '}')"""
_STATUS = f"""WITH {C.PRODUCTS_SQL}, s AS (SELECT *, CASE WHEN product_id % 17 = 0 THEN 'malformed'
  WHEN product_id % 8 = 0 OR NOT coalesce(rating_number >= 10 AND average_rating >= 4.0, false) THEN 'ineligible'
  WHEN product_id % 10 = 0 THEN 'missing_key' ELSE 'ok' END AS status FROM products)"""

QUERIES = {
    "normalize_title": (normalize_title, f"SELECT p_partkey, {C.title_sql(_NOISY)} AS title FROM part"),
    "retrieval_text": (
        retrieval_text,
        """SELECT p_partkey, array_to_string(list_filter([p_name, '- size ' || p_size, '- ' || p_type, CASE WHEN p_partkey % 4 <> 0 THEN 'Store: ' || p_brand END,
        CASE WHEN p_partkey % 3 = 0 THEN 'Style: ' || p_type END, 'Material: steel'], lambda x: x IS NOT NULL), chr(10)) AS retrieval_text FROM part""",
    ),
    "clean_features": (clean_features, f"SELECT doc_id, len({_CLEAN}) AS n, array_to_string({_CLEAN}, chr(10)) AS features FROM documents"),
    "first_six_features": (first_six_features, f"SELECT doc_id, array_to_string(({_CLEAN})[1:6], chr(10)) AS features FROM documents"),
    "first_image_url": (
        first_image_url,
        f"SELECT event_id, replace([{_IMAGE_LIST}][1 + json_extract_string(props, '$.k')::bigint % {len(IMAGES)}], '#', event_id::varchar) AS url FROM events",
    ),
    "json_props_extract": (
        json_props_extract,
        f"""WITH t AS (SELECT event_id, {_PROPS} AS p FROM events)
        SELECT event_id, try_cast(json_extract_string(p, '$.k') AS bigint) AS k, coalesce(trim(json_extract_string(p, '$.name')) <> '', false) AS has_name,
        coalesce(json_array_length(p, '$.list'), 0)::int AS n_list FROM t""",
    ),
    "token_estimate": (token_estimate, "SELECT doc_id, greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS tokens FROM documents"),
    "ingest_products": (
        ingest_products,
        f"""{_STATUS} SELECT 'P' || product_id AS parent_asin, title, store, average_rating, rating_number, price,
        CASE WHEN product_id % 9 <> 0 THEN 'https://img.example/' || product_id END AS image_url, 'one|two' AS features, {C.title_sql('title')} AS normalized_title,
        title || chr(10) || '- one' || chr(10) || '- two' || chr(10) || 'Store: ' || store || chr(10) || 'Material: wool' AS retrieval_text FROM s WHERE status = 'ok'""",
    ),
    "ingest_rejects": (
        ingest_rejects,
        f"""{_STATUS}, r AS (SELECT status AS reason FROM s UNION ALL SELECT 'dropped_image_url' FROM s WHERE status = 'ok' AND product_id % 9 = 0)
        SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    ),
}
