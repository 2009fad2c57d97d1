"""Curation: ordered choice of up to k candidates without repeated titles and with few per store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import at_least
from quern.functions.text import strip

STORE_CAP = 2


def title_key(normalized_title: Column, identity: Column) -> Column:
    """What counts as the same title: the stripped title, or the row itself where it is blank."""
    return F.coalesce(F.nullif(strip(normalized_title), F.lit("")), identity.cast("string"))


def store_key(store: Column) -> Column:
    """What the cap counts; blank is not capped."""
    return F.coalesce(strip(store), F.lit(""))


def choose(candidates: Column, k: Column, cap: int = STORE_CAP) -> Column:
    """Places of the chosen entries, in order, of an ordered array of struct(place, title, store, …).

    First in order, without titles chosen before and stores chosen ``cap`` times; then, if
    fewer than k, in order again without regard to stores. An entry passed over leaves its
    title and its store's quota free, so the choice is a fold over the (short) pool.
    """
    none = F.struct(
        F.array().cast("array<int>").alias("sel"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("stores")
    )

    def take(acc: Column, x: Column, full: Column) -> Column:
        chosen = F.struct(
            F.array_append(acc["sel"], x["place"]).alias("sel"),
            F.array_append(acc["seen"], x["title"]).alias("seen"),
            F.array_append(acc["stores"], x["store"]).alias("stores"),
        )
        return F.when(full, acc).otherwise(chosen)

    def barred(acc: Column, x: Column) -> Column:
        return (F.size(acc["sel"]) >= k) | F.array_contains(acc["seen"], x["title"])

    def capped(acc: Column, x: Column) -> Column:
        return (x["store"] != "") & (F.size(F.filter(acc["stores"], lambda s: s == x["store"])) >= cap)

    first = F.aggregate(candidates, none, lambda acc, x: take(acc, x, barred(acc, x) | capped(acc, x)))
    return F.aggregate(candidates, first, lambda acc, x: take(acc, x, barred(acc, x)), lambda acc: acc["sel"])


def curate(candidates: DataFrame, k: Column | int, by: list[str], cap: int = STORE_CAP) -> DataFrame:
    """Chosen rows with ``rank`` from 1. ``candidates`` has place, title, store_cap_key and any
    other columns; ``by`` groups them into queries, whose pools are small."""
    others = [c for c in candidates.columns if c not in by]
    entry = F.struct(F.col("place"), F.col("title_key").alias("title"), F.col("store_key").alias("store"), F.struct(*others).alias("row"))
    pools = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("pool"))
    limit = F.lit(k) if isinstance(k, int) else k
    chosen = pools.withColumn("chosen", choose(F.col("pool"), limit, cap))
    rows = chosen.select(*by, "pool", F.posexplode("chosen").alias("at", "place"))
    found = F.element_at(F.filter("pool", lambda x: x["place"] == F.col("place")), 1)["row"]
    return rows.select(*by, (F.col("at") + 1).alias("rank"), found.alias("row")).select(*by, "rank", "row.*")


def quality_gate(ranked: DataFrame, min_count: int = 10, min_average: float = 4.0) -> DataFrame:
    """Rows with enough and good ratings; ranks keep their gaps. A NaN rating does not pass."""
    return ranked.filter((F.coalesce(F.col("rating_number") >= min_count, F.lit(False))) & at_least(F.col("average_rating"), min_average))
