"""Requests to responses: parse, embed, search, curate, gate, explain, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import curation, explain, search
from quern.providers import INTENT_DDL, Embedder, Explainer, IntentParser, embed_column, explain_column, parse_column
from quern.session import bounded, stash

#: What a response shows of a product: all but the internal texts.
SHOWN = ("parent_asin", "title", "store", "average_rating", "rating_number", "price", "image_url", "features")

INTENT_FIELDS = (*(f.split()[0] for f in INTENT_DDL.split(", ")), "original_query")
INTENT_TYPE = "struct<" + ",".join(f.replace(" ", ":") for f in f"{INTENT_DDL}, original_query string".split(", ")) + ">"


@dataclass
class Recommender:
    """Answers batches of requests over products (row_index and product columns) and their
    vectors (row_index, embedding)."""

    products: DataFrame
    vectors: DataFrame
    embedder: Embedder | None
    parser: IntentParser | None
    explainer: Explainer | None
    pool: int = 40
    min_count: int = 10
    min_average: float = 4.0
    broadcast_rows: int = 200_000  # pools are broadcast to the products up to this many rows

    def answer(self, requests: DataFrame) -> DataFrame:
        """query_id, status, query, intent and results (product, score, rank, why_this_matches, by
        rank) of every request (query_id, query, max_results).

        Statuses: ok, no_results, invalid_request, missing_api_key (a provider is None, or has no
        key), upstream_error (a model's answer is missing or does not fit), internal_error (an
        intent beyond its limits). One request's failure leaves the others alone. The batch
        bounds what is written between steps: its requests and their pools.
        """
        checked = stash(explain.validate_requests(requests), "requests")
        valid = checked.filter("status = 'ok'").select("query_id", "query")
        if None in (self.embedder, self.parser, self.explainer):
            absent = valid.select("query_id", F.lit("missing_api_key").alias("status"))
            none = self.products.select(F.struct(*SHOWN).alias("product")).schema.simpleString()
            empty = F.lit(None).cast(f"array<struct<rank:int,product:{none[len('struct<product:'):-1]},score:double,why_this_matches:string>>")
            status = explain.outcomes(checked, valid.limit(0), "query_id", absent)
            return status.join(checked.select("query_id", "query"), "query_id").withColumns({"intent": F.lit(None).cast(INTENT_TYPE), "results": empty})
        parsed = stash(explain.clean_intent(parse_column(valid, self.parser, "query_id", "query")), "intents")
        fits = F.length("retrieval_text").between(1, explain.INTENT_MAX)
        failed = parsed.select("query_id", F.coalesce("error", F.when(~fits, "internal_error")).alias("status")).filter("status is not null")
        intents = parsed.filter(F.col("error").isNull() & fits).drop("error")
        asked = stash(embed_column(intents, self.embedder, "query_id", "retrieval_text", errors=True), "asked")
        failed = failed.unionByName(asked.filter("error is not null").select("query_id", F.col("error").alias("status")))
        best = search.batch_candidates(self.vectors, asked.filter("error is null"), max(self.pool, explain.RESULTS_MAX), "row_index")
        found = stash(best, "pools")
        search.release(best)
        rows = bounded(found, self.broadcast_rows).join(self.products, "row_index")
        keys = {"title_key": curation.title_key(F.col("normalized_title"), F.col("parent_asin")), "store_key": curation.store_key(F.col("store"))}
        rows = rows.withColumns(keys).join(checked.select("query_id", F.col("max_results").alias("k")), "query_id")
        chosen = curation.curate(rows, F.element_at("pool", 1)["row"]["k"], ["query_id"])
        ranked = stash(curation.quality_gate(chosen, self.min_count, self.min_average), "ranked")
        intent = explain.intent_lines({c: F.col(c) for c in ("original_query", *explain.INTENT_TEXTS, "garment_types", "attributes")})
        product = {c: F.col(c) for c in ("title", "store", "price", "features", "average_rating", "rating_number")}
        prompts = explain.explain_prompts(ranked.join(intents.drop("query", "retrieval_text"), "query_id"), ["query_id"], intent, product)
        ranks = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
        said = stash(explain_column(prompts.join(ranks, "query_id"), self.explainer, "query_id"), "said")
        silent = said.filter("error is not null").select("query_id", F.col("error").alias("status"))
        merged, verdicts = explain.merge_explanations(ranked.join(silent, "query_id", "left_anti"), said.filter("error is null").drop("error"), ["query_id"])
        failed = failed.unionByName(silent).unionByName(verdicts.filter("verdict <> 'ok'").select("query_id", F.lit("upstream_error").alias("status")))
        entry = F.struct(F.col("rank"), F.struct(*SHOWN).alias("product"), F.col("score"), F.col("why_this_matches"))
        results = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"]).alias("results"))
        status = explain.outcomes(checked, ranked.select("query_id"), "query_id", failed)
        told = intents.select("query_id", F.struct(*INTENT_FIELDS).alias("intent"))
        return status.join(checked.select("query_id", "query"), "query_id").join(told, "query_id", "left").join(results, "query_id", "left")


def load_checked(vectors: DataFrame, manifest: dict, dimensions: int) -> DataFrame:
    """``vectors`` after their manifest and every row have been checked."""
    from quern.operators.embed_job import audit
    from quern.sources.files import check_manifest

    found = audit(vectors, dimensions)
    check_manifest(manifest, found["rows"], dimensions)
    if found["not_unit"] or found["other_size"]:
        raise ValueError(f"vectors are not unit vectors of {dimensions}: {found}")
    return vectors


def load_aligned(spark: SparkSession, products_path: str, matrix_path: str, manifest: dict) -> DataFrame:
    """row_index, the product columns and embedding: product lines and the rows of a matrix, each at its place.

    Lines are numbered by file and place and take their matrix row in the task that reads them, so nothing is shuffled. That they belong together is
    checked first: rows and dimensions against the manifest, every vector's length, and the two digests that the embedding job
    left, of texts and of vectors with their places. A line or a row that is missing, added, changed or shifted by one raises.
    """
    from quern.operators.embed_job import digest
    from quern.sources import npy
    from quern.sources.files import placed_products, product_texts

    rows, dimensions = npy.shape_of(matrix_path)
    products = placed_products(spark, products_path)
    if (n := products.count()) != rows:
        raise ValueError(f"{n} product lines and {rows} matrix rows do not go together")
    if missing := {"texts_digest", "vectors_digest"} - set(manifest):
        raise ValueError(f"the manifest lacks {', '.join(sorted(missing))}")
    if digest(product_texts(products).select("row_index", F.col("text").alias("embedding")), "row_index") != manifest["texts_digest"]:
        raise ValueError(f"the lines at {products_path} are not those that were embedded, in their order")
    zipped = npy.with_rows(products, matrix_path)
    load_checked(zipped, manifest, dimensions)
    if digest(zipped, "row_index") != manifest["vectors_digest"]:
        raise ValueError(f"the rows at {matrix_path} are not the vectors of the manifest, in their order")
    return zipped


__all__ = ["Recommender", "load_aligned", "load_checked", "SHOWN"]
