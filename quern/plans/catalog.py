"""The product catalog over the star-schema tables: titles, stores, ratings, prices, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize_title
from quern.operators.curation import store_key, title_key
from quern.session import bounded, stash

#: Ids of pools that are broadcast to parts and ratings.
POOL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, only: DataFrame | list[int] | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    if only is not None:
        lines = _within(lines, "l_partkey", only)
    return lines.groupBy("l_partkey").agg(F.count("*").alias("rating_number"), F.round(F.avg("l_quantity") / 6.25, 1).alias("average_rating"))


def _within(rows: DataFrame, key: str, only: DataFrame | list[int]) -> DataFrame:
    """The rows with a key in ``only``: a list becomes a filter that reaches the Parquet scan."""
    if isinstance(only, list):
        return rows.filter(F.col(key).isin(only))
    return rows.join(only, rows[key] == only["product_id"], "left_semi")


def products(spark: SparkSession, sf_dir: str, pool: DataFrame | list[int] | None = None) -> DataFrame:
    """product_id, title, store, price, average_rating, rating_number of every part, or of those in
    ``pool``: the ids of one pool, or the pools of a request batch, whose size the batch bounds.
    Pools of a batch are broadcast up to POOL_ROWS ids, and joined by shuffles beyond; only their
    ratings are grouped."""
    part, only = table(spark, sf_dir, "part"), pool
    if isinstance(pool, DataFrame):
        only = bounded(stash(pool.select("product_id").distinct(), "pool-ids"), POOL_ROWS)
    if only is not None:
        part = _within(part, "p_partkey", only)
    rated = part.join(ratings(spark, sf_dir, only), part["p_partkey"] == F.col("l_partkey"), "left")
    return rated.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"),
        F.col("p_retailprice").alias("price"), "average_rating", "rating_number",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("product_id"), "embedding")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that have a vector."""
    return products(spark, sf_dir).join(vectors(spark, sf_dir), "product_id")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the keys that curation compares."""
    return rows.withColumns({"title_key": title_key(normalize_title(F.col("title")), F.col("product_id")), "store_key": store_key(F.col("store"))})


#: The same in DuckDB.
RATINGS_SQL = "rt AS (SELECT l_partkey AS k, count(*) AS rating_number, round(avg(l_quantity) / 6.25, 1) AS average_rating FROM lineitem GROUP BY l_partkey)"
PRODUCTS_SQL = (
    f"{RATINGS_SQL},\nproducts AS (SELECT p_partkey AS product_id, p_name AS title, p_brand AS store, p_retailprice AS price, "
    "average_rating, rating_number FROM part LEFT JOIN rt ON rt.k = p_partkey)"
)
CATALOG_SQL = f"{PRODUCTS_SQL},\ncat AS (SELECT products.*, embedding FROM products JOIN embeddings ON vec_id = product_id)"
TITLE_SQL = """array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)', ' ', 'g'),
  '\\b(size|small|medium|large|x-large|xl|xxl|xs|s|m|l)\\b', ' ', 'g'), '\\b\\d+(\\.\\d+)?\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:12], ' ')"""


def title_sql(c: str) -> str:
    return TITLE_SQL.format(c=c)
