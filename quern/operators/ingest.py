"""Ingest of raw JSON product lines: typed records, eligibility, counted rejects.

A line is parsed to a VARIANT, since fields change their type from line to line; every field
is read with a guard on its type, and casts that can fail give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

MIN_COUNT, MIN_AVERAGE = 10, 4.0

PRODUCT_COLUMNS = (
    "parent_asin", "title", "store", "average_rating", "rating_number", "price", "image_url", "features", "normalized_title", "retrieval_text",
)


#: The fields of a line that are read.
RAW_FIELDS = ("parent_asin", "title", "store", "average_rating", "rating_number", "price", "images", "features", "details")


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _string(v: Column) -> Column:
    """The value where it is a JSON string."""
    return F.when(F.schema_of_variant(v) == "STRING", _get(v, "string"))


def _list(v: Column) -> Column:
    """The value where it is a JSON array, else an empty one."""
    return F.coalesce(_get(v, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _number(v: Column, kind: str) -> Column:
    """A number, a numeric string, or a boolean as 0 or 1."""
    as_double = F.when(F.schema_of_variant(v) == "BOOLEAN", _get(v, "boolean").cast("double")).otherwise(
        F.coalesce(_get(v, "double"), T.strip(_get(v, "string")).try_cast("double"))
    )
    return as_double if kind == "double" else F.when(~F.isnan(as_double) & (F.abs(as_double) < 9.0e18), as_double.cast("bigint"))


def bronze(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with ``v``: the parsed line, null where it is no JSON."""
    return lines.withColumn("v", F.try_parse_json(value))


def first_image_url(images: Column) -> Column:
    """Of the first image alone, if it is an object: the first of large, hi_res and thumb that is not empty."""
    first = F.try_element_at(images, F.lit(1))
    return F.coalesce(*[F.nullif(F.try_variant_get(first, f"$.{k}", "string"), F.lit("")) for k in ("large", "hi_res", "thumb")])


def reason_column(title: Column, images: Column, features: Column, count: Column, average: Column, min_count: int = MIN_COUNT, min_average: float = MIN_AVERAGE) -> Column:
    """The first rule that a row fails: no_title, no_image, no_features, few_ratings, low_rating; null where it
    fails none. An average that is NaN passes, as it is not below."""
    rules = {"no_title": title, "no_image": images, "no_features": features, "few_ratings": count >= min_count, "low_rating": average >= min_average}
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def eligible_column(title: Column, images: Column, features: Column, count: Column, average: Column) -> Column:
    """Whether a row has a title, images and features (the first three), and ratings enough; never null."""
    return reason_column(title, images, features, count, average).isNull()


def status_column(malformed: Column, eligible: Column, key: Column) -> Column:
    return F.when(malformed, "malformed").when(~eligible, "ineligible").when(~key, "missing_key").otherwise("ok")


def silver(raw: DataFrame) -> DataFrame:
    """All columns of ``raw`` but v, PRODUCT_COLUMNS and ``status``: ok, malformed, ineligible, missing_key.

    A row is eligible with a title, any images, any features, at least MIN_COUNT ratings and
    an average of at least MIN_AVERAGE (NaN passes, as it is not below). An image address
    that is no URL becomes null and sets ``image_dropped``; so does a price that is no number.
    """
    carried = [F.col(f"`{c}`") for c in raw.columns if c not in ("v", "value")]
    # Every field is taken from the line once, and once cast to what it is used as.
    fields = F.try_variant_get("v", "$", f"struct<{', '.join(f'{f}: variant' for f in RAW_FIELDS)}>")
    raw = raw.select(*carried, F.col("v").isNull().alias("_bad"), fields.alias("_f"))
    f = {name: F.col(f"_f.{name}") for name in RAW_FIELDS}
    cast = {"title": _string(f["title"]), "features": _list(f["features"]), "images": _list(f["images"]), "key": _string(f["parent_asin"]), "store": _string(f["store"])}
    cast |= {"count": _number(f["rating_number"], "bigint"), "average": _number(f["average_rating"], "double"), "price": _number(f["price"], "double")}
    cast |= {"details": _get(f["details"], "map<string, variant>")}
    raw = raw.select(*carried, "_bad", *[c.alias(f"_{name}") for name, c in cast.items()])
    title, features, images, key, store, count, average = (F.col(f"_{c}") for c in ("title", "features", "images", "key", "store", "count", "average"))
    eligible = eligible_column(T.has_text(title), F.size(images) > 0, F.size(features) > 0, count, average)
    status = status_column(F.col("_bad"), eligible, T.has_text(key))
    texts = F.transform(features, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    image = first_image_url(images)
    details = [(k, _string(F.try_element_at("_details", F.lit(k)))) for k in T.DETAIL_KEYS]
    valid = T.is_http_url(image)
    return raw.select(
        *carried,
        status.alias("status"),
        key.alias("parent_asin"),
        T.strip(title).alias("title"),
        T.blank_to_null(store).alias("store"),
        average.alias("average_rating"),
        count.alias("rating_number"),
        F.col("_price").alias("price"),
        F.when(valid, image).alias("image_url"),
        T.clean_list(texts).alias("features"),
        T.normalize_title(T.strip(title)).alias("normalized_title"),
        T.retrieval_text(title, texts, store, details).alias("retrieval_text"),
        (image.isNotNull() & ~valid).alias("image_dropped"),
    )


def products(silvered: DataFrame) -> DataFrame:
    return silvered.filter("status = 'ok'").select(*PRODUCT_COLUMNS)


def reject_samples(silvered: DataFrame, order: str, n: int = 3) -> DataFrame:
    """status, order, parent_asin: the first ``n`` rows of every status but ok."""
    first = F.row_number().over(Window.partitionBy("status").orderBy(order))
    return silvered.filter("status <> 'ok'").select("status", order, "parent_asin").withColumn("_place", first).filter(F.col("_place") <= n).drop("_place")


def reject_counts(silvered: DataFrame) -> DataFrame:
    """reason, n: rows per status, and rows whose image was dropped."""
    kept = F.when((F.col("status") == "ok") & F.col("image_dropped"), F.lit("dropped_image_url"))
    return silvered.select(F.explode(F.array_compact(F.array("status", kept))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
