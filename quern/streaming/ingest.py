"""Structured Streaming: new product lines and request files as they arrive.

A batch writes each of its tables to a folder of its own, products/stream=<id>/epoch=<n>, replacing
what an earlier try of the same batch has left there, and then puts a marker with all counts in place in one
step. A batch that is repeated, after a stop between two writes or before the marker, gives the same folders
again, so every row is there once. Readers take the batches that have a marker (``committed``), so
products and rejects of a batch show up together. The stream's id comes from its
checkpoint: a new checkpoint begins new folders and replaces none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ingest
from quern.session import discard, stash
from quern.sources import shared

REQUEST_DDL = "query_id bigint, query string, max_results int"
MARKER = re.compile(r"stream=(.+)-epoch=(\d+)\.json")


def stream_of(batch: DataFrame) -> str:
    """The id that the checkpoint gives its stream; all runs from it have the same."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def commit_batch(batch: DataFrame, epoch: int, tables: dict[str, DataFrame], markers: str) -> None:
    """Writes ``tables`` (by the path they belong to) as those of ``epoch``, and then the marker."""
    spark, stream = batch.sparkSession, stream_of(batch)
    counts = {}
    for path, table in tables.items():
        at = f"{path.rstrip('/')}/stream={stream}/epoch={epoch}"
        table.write.mode("overwrite").parquet(at)
        counts[path] = spark.read.schema(table.schema).parquet(at).count()
    shared.write_json(spark, {"stream": stream, "epoch": epoch, "rows": counts}, f"{markers.rstrip('/')}/stream={stream}-epoch={epoch}.json")


def committed(spark: SparkSession, path: str, markers: str) -> DataFrame | None:
    """The rows at ``path`` of all batches that have a marker, with stream and epoch; None before the first."""
    known = [MARKER.fullmatch(name) for name in shared.files(spark, markers)]
    folders = [f"{path.rstrip('/')}/stream={m[1]}/epoch={m[2]}" for m in known if m]
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def stream_products(spark: SparkSession, lines: str, products: str, rejects: str, checkpoint: str, markers: str | None = None):
    """Files under ``lines`` are ingested once each: products, and reject counts by reason. The commit log
    in ``checkpoint`` makes a restarted query go on where it stopped; ``markers`` (beside ``products`` where it is not given) has the batches' markers."""
    at = markers or f"{products.rstrip('/')}.markers"

    def each(batch: DataFrame, epoch: int) -> None:
        silvered = stash(ingest.silver(ingest.bronze(batch)), f"epoch-{epoch}")
        commit_batch(batch, epoch, {products: ingest.products(silvered), rejects: ingest.reject_counts(silvered)}, at)
        discard(silvered)

    source = spark.readStream.text(lines)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_requests(spark: SparkSession, requests: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], responses: str, markers: str | None = None):
    """Request files under ``requests`` are answered batch by batch with ``answer``. A repeated batch asks again, and its
    answers replace those of the try before."""
    at = markers or f"{responses.rstrip('/')}.markers"

    def each(batch: DataFrame, epoch: int) -> None:
        commit_batch(batch, epoch, {responses: answer(batch)}, at)

    source = spark.readStream.schema(REQUEST_DDL).json(requests)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reject_totals(spark: SparkSession, rejects: str, markers: str) -> DataFrame | None:
    """reason, n over all committed batches."""
    found = committed(spark, rejects, markers)
    return None if found is None else found.groupBy("reason").agg(F.sum("n").alias("n"))
