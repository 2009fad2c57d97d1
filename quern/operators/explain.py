"""Prompts, explanations and request outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numbers import fixed

QUERY_MIN, QUERY_MAX, RESULTS_MAX, RESULTS_DEFAULT = 3, 500, 20, 8
INTENT_MAX = 1000
FEATURE_LIMIT = 6
INTENT_TEXTS = ("occasion", "season", "audience", "price_preference")


def validate_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with the query stripped, max_results filled in, and ``status``: ok or invalid_request."""
    query = T.strip("query")
    results = F.coalesce("max_results", F.lit(RESULTS_DEFAULT)) if "max_results" in requests.columns else F.lit(RESULTS_DEFAULT)
    fine = query.isNotNull() & F.length(query).between(QUERY_MIN, QUERY_MAX) & results.between(1, RESULTS_MAX)
    return requests.withColumns({"query": query, "max_results": results, "status": F.when(F.coalesce(fine, F.lit(False)), "ok").otherwise("invalid_request")})


def clean_intent(intents: DataFrame) -> DataFrame:
    """Intents with blanks as null, lists cleaned, and the query where there is no retrieval text."""
    own = T.strip("query")
    fixed_up = {c: T.blank_to_null(c) for c in INTENT_TEXTS} | {c: T.clean_list(c) for c in ("garment_types", "attributes")}
    return intents.withColumns(fixed_up | {"original_query": own, "retrieval_text": F.coalesce(T.blank_to_null("retrieval_text"), own)})


def query_prompt(query: Column) -> Column:
    return F.concat(F.lit("Shopper query: "), query)


def intent_lines(intent: dict[str, Column]) -> Column:
    """The intent as prompt lines: the query, then what is not blank. Lists are joined by commas."""
    none = F.array().cast("array<string>")
    lines = [F.array(F.concat(F.lit("- original_query: "), intent["original_query"]))]
    for name in ("occasion", "season", "garment_types", "attributes", "audience", "price_preference"):
        value = F.nullif(F.array_join(T.clean_list(intent[name]), ", "), F.lit("")) if name in ("garment_types", "attributes") else T.blank_to_null(intent[name])
        lines.append(F.when(value.isNotNull(), F.array(F.concat(F.lit(f"- {name}: "), value))).otherwise(none))
    return F.concat(*lines)


def product_block(rank: Column, product: dict[str, Column]) -> Column:
    """A ranked product as prompt text."""
    none = F.array().cast("array<string>")
    store, features = T.blank_to_null(product["store"]), F.slice(T.clean_list(product["features"]), 1, FEATURE_LIMIT)
    lines = F.concat(
        F.array(
            F.concat(F.lit("Product rank "), rank.cast("string"), F.lit(":")),
            F.concat(F.lit("- title: "), product["title"]),
            F.concat(F.lit("- average_rating: "), fixed(product["average_rating"], 1)),
            F.concat(F.lit("- rating_number: "), product["rating_number"].cast("string")),
        ),
        F.when(store.isNotNull(), F.array(F.concat(F.lit("- store: "), store))).otherwise(none),
        F.when(product["price"].isNotNull(), F.array(F.concat(F.lit("- price: $"), fixed(product["price"], 2)))).otherwise(none),
        F.when(F.size(features) > 0, F.concat(F.array(F.lit("- features:")), F.transform(features, lambda f: F.concat(F.lit("  - "), f)))).otherwise(none),
    )
    return F.array_join(lines, "\n")


def explain_prompts(ranked: DataFrame, by: list[str], intent: Column, product: dict[str, Column]) -> DataFrame:
    """by, prompt: one prompt per query with its products by rank. A query has at most RESULTS_MAX."""
    blocks = ranked.select(*by, intent.alias("intent"), F.col("rank"), product_block(F.col("rank"), product).alias("block"))
    grouped = blocks.groupBy(*by).agg(F.first("intent").alias("intent"), F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return grouped.select(*by, F.concat(F.lit("Shopper intent:\n"), F.array_join("intent", "\n"), F.lit("\n\nProducts:\n"), text).alias("prompt"))


def merge_explanations(ranked: DataFrame, explanations: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with why_this_matches, verdicts by query: ok, duplicate_rank or rank_mismatch).

    Blank explanations do not count. A query with an entry for a rank that has a text already
    (``place``, where there is one, orders the entries), or whose ranks differ from those of
    its products, yields no rows.
    """
    why = F.nullif(T.collapse_spaces("why_this_matches"), F.lit(""))
    place = F.col("place") if "place" in explanations.columns else F.lit(0)
    said = explanations.select(*by, "rank", why.alias("why"), place.alias("place"))
    texts = said.groupBy(*by, "rank").agg(
        F.count("why").alias("n"), F.min("why").alias("why_this_matches"), F.min(F.when(F.col("why").isNotNull(), F.col("place"))).alias("first"), F.max("place").alias("last")
    )
    texts = texts.filter("n > 0").withColumn("again", (F.col("n") > 1) | (F.col("last") > F.col("first"))).drop("first", "last")
    both = ranked.select(*by, "rank", F.lit(1).alias("have")).join(texts, [*by, "rank"], "full_outer")
    verdicts = both.groupBy(*by).agg(
        F.when(F.coalesce(F.bool_or("again"), F.lit(False)), "duplicate_rank")
        .when((F.count_if(F.col("have").isNull()) > 0) | (F.count_if(F.col("n").isNull()) > 0), "rank_mismatch")
        .otherwise("ok")
        .alias("verdict")
    )
    good = verdicts.filter("verdict = 'ok'").select(*by)
    merged = ranked.join(texts.drop("n", "again"), [*by, "rank"]).join(good, by, "left_semi")
    return merged, verdicts


def outcomes(requests: DataFrame, results: DataFrame, by: str, errors: DataFrame | None = None) -> DataFrame:
    """``by``, status of every request: invalid_request, the status in ``errors``, ok, or no_results."""
    found = results.select(by).distinct().withColumn("found", F.lit(True))
    joined = requests.join(found, by, "left")
    failed = F.lit(None).cast("string")
    if errors is not None:
        joined = joined.join(errors.select(by, F.col("status").alias("error")), by, "left")
        failed = F.col("error")
    status = F.when(F.col("status") != "ok", F.col("status")).when(failed.isNotNull(), failed).when(F.col("found"), "ok").otherwise("no_results")
    return joined.select(by, status.alias("status"))
