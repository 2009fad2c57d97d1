"""Command line: ingest, profile, embed and recommend.

    python -m quern.cli ingest --input raw.jsonl.gz --output products
    python -m quern.cli profile --input raw.jsonl.gz --output report.md
    python -m quern.cli embed --input products --output vectors --manifest manifest.json [--limit N]
    python -m quern.cli recommend --products products --vectors vectors --query "linen dress"

``embed`` and ``recommend`` use offline models, or with --connect module:function a client's: the function gets the key of
the environment (or of --env-file) in the process that asks. Gzipped input of several members is inflated by many tasks with --gzip-members.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import providers as M
from quern.functions import text as T
from quern.functions.numbers import percent
from quern.operators import embed_job, explain, ingest, profile
from quern.operators.batching import MAX_INPUTS, MAX_TOKENS
from quern.pipeline import Recommender
from quern.session import local_session
from quern.sources import files


def positive_int(value: str) -> int:
    n = int(value)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return n


def run_ingest(spark: SparkSession, source: str, output: str, members: bool = False) -> DataFrame:
    lines = files.gzip_lines(spark, source) if members else files.indexed_lines(spark, source)
    silvered = ingest.silver(ingest.bronze(lines)).persist()
    # The rows that stay are counted anew, so that row_index has no gaps.
    kept = files.renumbered(silvered.filter("status = 'ok'").withColumnRenamed("row_index", "line"), "line", "row_index")
    kept.select("row_index", *ingest.PRODUCT_COLUMNS).write.parquet(output)
    first = ingest.reject_samples(silvered, "row_index").select(F.format_string("%s: first at %d", "status", "row_index").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    return ingest.reject_counts(silvered).unionByName(first).orderBy("reason")


PREFERRED = "preferred_rn10_avg4_features"
SAMPLES, SIZED_ROWS, EMPTY_BYTES, DIMENSIONS = 8, 500, 900, 1536


def _profiled(raw: DataFrame) -> DataFrame:
    """The fields of bronze lines that a profile reads."""
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>").alias(k) for k in ("features", "description", "images")]
    texts = [F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("title", "store", "price", "parent_asin")]
    numbers = [F.try_variant_get("v", "$.rating_number", "bigint").alias("rating_number"), F.try_variant_get("v", "$.average_rating", "double").alias("average_rating")]
    return raw.select("row_index", *lists, *texts, *numbers)


def size_estimates(members: DataFrame, pools: DataFrame) -> DataFrame:
    """pool, rows, metadata_mib, vectors_mib and startup_mib: what a service holds that loads the whole pool. The mean
    bytes of a row's metadata are taken over the pool's first rows."""
    shown = F.to_json(F.struct("parent_asin", "title", "store", "average_rating", "rating_number", "price", "features"))
    place = F.row_number().over(Window.partitionBy("pool").orderBy("row_index"))
    first = members.withColumn("_place", place).filter(F.col("_place") <= SIZED_ROWS)
    means = first.groupBy("pool").agg(F.avg(F.octet_length(shown)).alias("mean"))
    mib = lambda c: F.round(c / (1 << 20), 1)
    metadata, vectors = F.coalesce("mean", F.lit(float(EMPTY_BYTES))) * F.col("n"), F.col("n") * DIMENSIONS * 4
    joined = pools.select("pool", "n").join(means, "pool", "left")
    return joined.select("pool", F.col("n").alias("rows"), mib(metadata).alias("metadata_mib"), mib(vectors).alias("vectors_mib"), mib(metadata + vectors).alias("startup_mib"))


def run_profile(spark: SparkSession, source: str) -> str:
    """A Markdown report: rows, presence, quantiles, pools and their sizes, and of the preferred pool the
    largest stores and categories and a sample."""
    raw = ingest.bronze(files.indexed_lines(spark, source))
    status = ingest.silver(raw).groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
    v = _profiled(raw).persist()
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rules = {"title": T.has_text("title"), "features": some("features"), "description": some("description"), "images": some("images")}
    rules |= {c: F.col(c).isNotNull() for c in ("price", "average_rating", "rating_number")} | {c: F.coalesce(F.col(c) != "", F.lit(False)) for c in ("store", "parent_asin")}
    present = profile.presence(v, rules).withColumn("share", percent(F.col("present"), F.col("total")))
    sizes = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("features", "description", "images")}
    spread = profile.quantiles(v, {"rating_number": F.col("rating_number"), "average_rating": F.col("average_rating"), **sizes})
    members = profile.pool_members(v, profile.pool_rules(rules["title"], rules["images"], rules["features"], rules["description"], F.col("rating_number"), F.col("average_rating")))
    total = v.count()
    summary = profile.pool_summary(members, F.col("price"), F.col("store"), T.normalize_title(F.coalesce("title", F.lit(""))))
    summary = summary.withColumn("share", percent(F.col("n"), F.lit(total))).withColumn("priced_share", percent(F.col("priced"), F.col("n"))).persist()
    chosen = members.filter(F.col("pool") == PREFERRED)
    stores = profile.top_groups(chosen, F.coalesce(F.nullif("store", F.lit("")), F.lit("Unknown")), 10)
    labels = profile.top_groups(chosen.select(F.explode(T.categories("title")).alias("label")), F.col("label"), 10)
    sample = profile.bottom_sample(chosen, "parent_asin", SAMPLES, "profile").select("parent_asin", "title", "average_rating", "rating_number", "store")
    parts = (
        ("Rows", status), ("Presence", present), ("Quantiles", spread.orderBy("measure", "p")), ("Pools", summary.orderBy("pool")), ("Sizes", size_estimates(members, summary).orderBy("pool")),
        ("Stores", stores), ("Categories", labels), ("Sample", sample),
    )
    policy = (
        f"## Policy\n\nThe pool `{PREFERRED}` is kept whole: title, images and features present, at least {ingest.MIN_COUNT} ratings of {ingest.MIN_AVERAGE} or more on average. "
        "The pools above show what a looser or stricter rule would keep; price is optional, since few rows have one."
    )
    return "\n\n".join([*(f"## {name}\n\n{files.markdown_table(df)}" for name, df in parts), policy]) + "\n"


def providers(a: argparse.Namespace) -> M.Providers:
    models = tuple(m.strip() for m in a.text_models.split(",") if m.strip())
    return M.providers_of(a.connect, a.env_file, a.embedding_model, a.dimensions, models, a.intent_shape, a.explanations_shape)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "profile", "embed"):
        one = sub.add_parser(name)
        one.add_argument("--input", required=True)
        one.add_argument("--output", required=name != "embed", default=embed_job.DEFAULT_OUTPUT)
    one.add_argument("--manifest")
    one.add_argument("--max-inputs-per-request", type=positive_int, default=MAX_INPUTS)
    one.add_argument("--max-estimated-tokens-per-request", type=positive_int, default=MAX_TOKENS)
    one.add_argument("--request-timeout-seconds", type=float, default=60.0)
    one.add_argument("--limit", type=positive_int)
    sub.choices["ingest"].add_argument("--gzip-members", action="store_true")
    ask = sub.add_parser("recommend")
    for name in ("--products", "--vectors", "--query"):
        ask.add_argument(name, required=True)
    ask.add_argument("--max-results", type=positive_int, default=explain.RESULTS_DEFAULT)
    for command in (one, ask):
        for name in ("--connect", "--env-file", "--intent-shape", "--explanations-shape"):
            command.add_argument(name)
        command.add_argument("--embedding-model", default="")
        command.add_argument("--dimensions", type=positive_int, default=DIMENSIONS)
        command.add_argument("--text-models", default="")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    if a.command == "ingest":
        print(files.markdown_table(run_ingest(spark, a.input, a.output, a.gzip_members)))
    elif a.command == "profile":
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(run_profile(spark, a.input))
    elif a.command == "embed":
        texts = files.product_texts(spark.read.parquet(a.input), a.limit)
        limits = (a.max_inputs_per_request, a.max_estimated_tokens_per_request, a.manifest, a.request_timeout_seconds)
        print(embed_job.run(spark, texts, providers(a).embedder, a.output, "row_index", *limits, input_path=a.input, limit=a.limit))
    else:
        products = spark.read.parquet(a.products)
        models, limits = providers(a), files.settings(path=a.env_file)
        rec = Recommender(products, spark.read.parquet(a.vectors), models.embedder, models.parser, models.explainer, limits["pool"], limits["min_count"], limits["min_average"])
        asked = spark.createDataFrame([(0, a.query, a.max_results)], "query_id bigint, query string, max_results int")
        for row in rec.answer(asked).toJSON().collect():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
