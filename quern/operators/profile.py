"""Profiling: presence, nearest-rank quantiles, candidate pools, top groups, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import at_least
from quern.functions.text import escape_pipes
from quern.session import stash


def presence(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """field, present, total: how many rows satisfy each rule, in one pass."""
    counted = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"p{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"p{i}").alias("present"), F.col("total").alias("total")) for i, name in enumerate(rules)])
    return counted.select(F.inline(rows))


def quantiles(df: DataFrame, measures: dict[str, Column], shares: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """measure, p, value: the entry at place round((n - 1) * p), half to even, of the sorted values; 0 without values.

    Values are counted first, so what is sorted grows with distinct values only; these are
    dealt out by range, and places are found with one offset per range.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("v")) for m, c in measures.items()]))
    counts = df.select(pairs).filter("v is not null").groupBy("measure", "v").count()
    dealt = stash(counts.repartitionByRange("measure", "v").withColumn("part", F.spark_partition_id()), "quantile-counts")
    # One row per measure and range.
    totals = dealt.groupBy("measure", "part").agg(F.sum("count").alias("held"))
    by_measure = Window.partitionBy("measure")
    totals = totals.select(
        "measure", "part", (F.sum("held").over(by_measure.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(by_measure).alias("n")
    )
    upto = F.sum("count").over(Window.partitionBy("measure", "part").orderBy("v"))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(totals), ["measure", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    wanted = placed.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares]))).filter(F.col("upto") > F.bround((F.col("n") - 1) * F.col("p")))
    found = wanted.groupBy("measure", "p").agg(F.min("v").alias("value"))
    asked = df.sparkSession.createDataFrame([(m, p) for m in measures for p in shares], "measure string, p double")
    return asked.join(found, ["measure", "p"], "left").select("measure", "p", F.coalesce("value", F.lit(0.0)).alias("value"))


def pool_rules(title: Column, images: Column, features: Column, description: Column, count: Column, average: Column) -> dict[str, Column]:
    """The six candidate pools. The first four arguments say whether there is one; null numbers count as 0."""
    n, a = F.coalesce(count, F.lit(0)), F.coalesce(average, F.lit(0.0))
    base, good = title & images, at_least(a, 4.0)
    return {
        "base_title_image": base,
        "preferred_rn10_avg4_features": base & features & (n >= 10) & good,
        "relaxed_rn5_avg4_features": base & features & (n >= 5) & good,
        "strict_rn25_avg4_features": base & features & (n >= 25) & good,
        "fallback_rn10_avg4_features_or_description": base & (features | description) & (n >= 10) & good,
        "rn10_features_no_avg_floor": base & features & (n >= 10),
    }


def pool_members(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``pool``: a row for each pool that a row is in."""
    hits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("pool", F.explode(hits))


def pool_summary(members: DataFrame, price: Column, store: Column, title: Column) -> DataFrame:
    """pool, n, priced, top_store_share and top_title_share, both to 6 decimals.

    Stores and titles are counted by (pool, key) with a partial aggregate before the largest is taken.
    """
    slim = members.select("pool", price.isNotNull().alias("priced"), F.coalesce(F.nullif(store, F.lit("")), F.lit("Unknown")).alias("store"), title.alias("title"))
    totals = slim.groupBy("pool").agg(F.count("*").alias("n"), F.count_if("priced").alias("priced"))

    def top(key: str) -> DataFrame:
        return slim.groupBy("pool", key).count().groupBy("pool").agg(F.max("count").alias(f"top_{key}"))

    share = lambda c: F.round(F.col(c) / F.col("n"), 6).alias(f"{c}_share")
    return totals.join(top("store"), "pool").join(top("title"), "pool").select("pool", "n", "priced", share("top_store"), share("top_title"))


def top_groups(df: DataFrame, key: Column, n: int) -> DataFrame:
    """key, count of the ``n`` largest groups, ties by key."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("key")).limit(n)


def bottom_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows whose md5 of seed and key is smallest: a sample that any engine repeats."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("mark", mark).orderBy("mark", key).limit(n)


def sample_fields(title: Column, store: Column, average_rating: Column, rating_number: Column, price: Column, features: Column, description: Column, images: Column) -> dict[str, Column]:
    """What a sample shows of a row: nine fields, lists by their size, the first image, and a title fit for a Markdown table."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return {
        "title": escape_pipes(title), "store": store, "average_rating": average_rating, "rating_number": rating_number, "price": price,
        "n_features": size(features), "n_description": size(description), "n_images": size(images), "first_image": F.try_element_at(images, F.lit(1)),
    }


def pool_samples(df: DataFrame, rules: dict[str, Column], key: str, fields: dict[str, Column], n: int, seed: str) -> DataFrame:
    """pool, place (from 1), key and ``fields`` of the ``n`` rows of every pool with the smallest md5 of seed and key.

    One pass for all pools. Spark limits a rank by task before it shuffles (a group limit below the
    window), so n rows for each task and pool are sent, and the groups at the end have only those.
    """
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    rows = df.select(F.col(key), mark.alias("_mark"), *[c.alias(f"_{name}") for name, c in fields.items()], F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]).alias("_pools"))
    members = rows.withColumn("pool", F.explode(F.array_compact("_pools"))).drop("_pools")
    place = F.row_number().over(Window.partitionBy("pool").orderBy("_mark", key))
    return members.withColumn("place", place).filter(F.col("place") <= n).select("pool", "place", key, *[F.col(f"_{name}").alias(name) for name in fields])
