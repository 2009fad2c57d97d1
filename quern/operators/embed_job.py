"""The embedding job: what is missing is cut into waves, each embedded, written and committed by itself.

    vectors/run=<n>/wave=<k>/       what finished runs have added
    vectors.staging/wave=<k>/       waves of the run under way, each a table of its own
    vectors.pending/wave=<k>/       its texts, copied once so that a wave reads only its own
    vectors.checkpoint.json         its settings, and the waves done
    vectors.manifest.json

A wave counts when its job has committed. A run that stops keeps every wave before; the next one with the
same settings asks only for what neither the output nor a committed wave has. Within a wave a failed
request loses its own rows alone: the others are kept, and the run ends with the wave. Staged rows and the
finished ones are checked together *before* they are published, which is one rename of the
staging folder into the output. Requests are formed inside the tasks that read the texts, so their limits hold
without a shuffle; ``planned`` gives those of one pass over all rows in order.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable, Iterator
from importlib import metadata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.text import token_estimate
from quern.operators.batching import MAX_INPUT_TOKENS, MAX_INPUTS, MAX_TOKENS, NextFit, batch_ids, check_budget
from quern.providers import Embedder, ask_vectors, is_transient
from quern.sources import shared
from quern.sources.files import PRICE_PER_MILLION, manifest_of

DEFAULT_OUTPUT = "data/vectors"
#: Rows of a wave: what a stop can lose at most.
WAVE_ROWS = 1 << 20
#: Of a checkpoint, what must agree with the run that goes on from it.
COMPARED = (
    "model", "dimensions", "key", "input_path", "input_sha256", "limit", "max_inputs_per_request", "max_estimated_tokens_per_request", "request_timeout_seconds",
)


def missing(texts: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows of ``texts`` that ``done`` has not: resuming needs no prefix, any set of rows may be done."""
    return texts if done is None else texts.join(done.select(key), key, "left_anti")


def guarded(texts: DataFrame, key: str) -> DataFrame:
    """``texts``; reading one beyond the input limit raises, naming its row."""
    over = F.raise_error(F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(f" has more than {MAX_INPUT_TOKENS} tokens"))).cast("string")
    return texts.withColumn("text", F.when(token_estimate("text") > MAX_INPUT_TOKENS, over).otherwise(F.col("text")))


def audit(embedded: DataFrame, dimensions: int) -> dict:
    """Counts of one pass over the vectors."""
    v = F.col("embedding")
    row = embedded.agg(
        F.count("*").alias("rows"), F.count_if(~V.is_unit(v)).alias("not_unit"), F.count_if(F.size(v) != dimensions).alias("other_size")
    ).first()
    return row.asDict()


def paths_of(output: str) -> dict[str, str]:
    """Where a job keeps what belongs to ``output``."""
    base = output.rstrip("/")
    return {"staging": f"{base}.staging", "pending": f"{base}.pending", "checkpoint": f"{base}.checkpoint.json", "manifest": f"{base}.manifest.json"}


def check_output(output: str, limit: int | None) -> None:
    """A run over part of the rows must not go to the default output."""
    if limit is not None and output.rstrip("/") == DEFAULT_OUTPUT:
        raise ValueError("a limited run needs an output of its own")


def check_checkpoint(found: dict, now: dict, rows_done: int, rows: int) -> None:
    """Raises where the checkpoint is of another job, or counts more rows than there are."""
    if differ := [k for k in COMPARED if found.get(k) != now.get(k)]:
        raise ValueError(f"the checkpoint is of another run: {', '.join(differ)} differ")
    if not 0 <= rows_done <= rows:
        raise ValueError(f"the checkpoint has {rows_done} rows, the input {rows}")


class EmbeddingFailed(RuntimeError):
    """Some rows of a wave have no vector; all others are kept."""


def requests(
    texts: DataFrame, key: str, max_inputs: int, max_tokens: int, serve: Callable[[list[str]], tuple[list, list[int]]], errors: bool = False
) -> DataFrame:
    """key, embedding, request (its number within the task), estimated_tokens, prompt_tokens, total_tokens: the rows of
    ``texts`` (key, text, and tokens where they are known), taken in order by requests that next-fit fills up to ``max_inputs`` texts
    and ``max_tokens`` estimated tokens; where ``texts`` has a column request (``planned``), by those. A request's usage stands on its first row. What is held is
    one request's texts, whatever the size of a task.

    With ``errors`` there is a column error, and a failed request does not end the task: where asking again later would help, its rows and
    all later ones of the task have the error and no vector; where it would not, its texts are asked for one by one.
    """
    kind = texts.schema[key].dataType.simpleString()
    ready = "request" in texts.columns
    names = [key, "embedding", "request", "estimated_tokens", "prompt_tokens", "total_tokens", *(["error"] if errors else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, held, open_batch, down = NextFit(max_inputs, max_tokens), [], 0, None
        key_type = None

        def answered(asked: list[str]) -> list[tuple]:
            """(vector, usage, error) of each text."""
            nonlocal down
            if down:
                return [(None, (0, 0), down)] * len(asked)
            try:
                rows, usage = serve(asked)
            except Exception as e:
                if not errors:
                    raise
                said = f"{type(e).__name__}: {e}"
                if is_transient(e):
                    down = said
                if down or len(asked) == 1:
                    return [(None, (0, 0), said)] * len(asked)
                return [one for text in asked for one in answered([text])]
            return [(v, usage if i == 0 else (0, 0), None) for i, v in enumerate(rows)]

        def send() -> pa.RecordBatch:
            found = answered([t for _, t, _ in held])
            arrays = [
                pa.array([k for k, _, _ in held], key_type), pa.array([v for v, _, _ in found], pa.list_(pa.float32())), pa.array([open_batch] * len(held), pa.int64()),
                pa.array([n for _, _, n in held], pa.int64()), *[pa.array([u[i] for _, u, _ in found], pa.int64()) for i in (0, 1)],
            ]
            if errors:
                arrays.append(pa.array([e for _, _, e in found], pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            key_type = b.column(0).type
            for k, text, tokens, *request in zip(*[c.to_pylist() for c in b.columns], strict=True):
                placed = request[0] if ready else fit.place(tokens)
                if placed != open_batch:
                    if held:
                        yield send()
                    held, open_batch = [], placed
                held.append((k, text, tokens))
        if held:
            yield send()

    ddl = f"{key} {kind}, embedding array<float>, request bigint, estimated_tokens bigint, prompt_tokens bigint, total_tokens bigint" + (", error string" if errors else "")
    tokens = F.col("tokens") if "tokens" in texts.columns else token_estimate(F.coalesce("text", F.lit("")))
    slim = texts.select(key, F.coalesce("text", F.lit("")).alias("text"), tokens.cast("bigint").alias("tokens"), *(["request"] if ready else []))
    return slim.mapInArrow(run, ddl)


def planned(texts: DataFrame, key: str, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``texts`` (key, text; keys differ) with tokens and request: the requests of next-fit over all rows in the order of ``key``. The rows
    of a request lie in one task, in order; a task has many requests."""
    counted = texts.select(key, token_estimate(F.coalesce("text", F.lit(""))).cast("bigint").alias("tokens"))
    placed = batch_ids(counted, key, "tokens", max_inputs, max_tokens).withColumnRenamed("batch", "request")
    return texts.select(key, "text").join(placed, key).repartition("request").sortWithinPartitions("request", key)


def embedded(texts: DataFrame, embedder: Embedder, key: str, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS, timeout: float = 60.0, errors: bool = False) -> DataFrame:
    """``requests`` answered by ``embedder``."""
    check_budget(max_tokens, timeout)

    def serve(part: list[str]) -> tuple[list, list[int]]:
        rows, *usage = ask_vectors(embedder, part, timeout)
        return list(np.asarray(rows, np.float32)), usage

    return requests(texts, key, max_inputs, max_tokens, serve, errors)


def digest(embedded: DataFrame, key: str) -> str:
    """Of the rows, in whatever order and files they lie: the xor and the sum of their hashes."""
    h = F.xxhash64(key, "embedding")
    row = embedded.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s")).first()
    return f"{(row.x or 0) & (1 << 64) - 1:016x}-{row.s or 0:x}"


def version_of(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def vectors_at(spark: SparkSession, output: str) -> DataFrame | None:
    """The table of a job's output, with the run and wave that each row came with; None where there is none."""
    return spark.read.parquet(output) if shared.exists(spark, output) else None


def committed_waves(spark: SparkSession, staging: str) -> list[int]:
    """Waves whose job has committed; what a wave that did not come to its end has left is deleted."""
    found = []
    for name in shared.folders(spark, staging):
        if shared.exists(spark, f"{staging}/{name}/_SUCCESS"):
            found.append(int(name.removeprefix("wave=")))
        else:
            shared.delete(spark, f"{staging}/{name}")
    return sorted(found)


def write_pending(left: DataFrame, path: str, waves: int) -> list[str]:
    """Copies the texts that are left to a folder for each wave, and returns the folders that have rows. A task's rows go to
    one wave, so there are as many files as tasks and nothing is shuffled, unless there are fewer tasks than waves."""
    spark = left.sparkSession
    shared.delete(spark, path)
    if waves > 1 and left.rdd.getNumPartitions() < waves:
        left = left.repartition(waves)
    wave = F.pmod(F.spark_partition_id(), F.lit(waves))
    left.withColumn("wave", wave).write.partitionBy("wave").parquet(path)
    return [f"{path}/{name}" for name in shared.folders(spark, path) if name.startswith("wave=")]


def run(
    spark: SparkSession, texts: DataFrame, embedder: Embedder, output: str, key: str = "row_index", max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS,
    manifest_path: str | None = None, timeout: float = 60.0, input_path: str | None = None, limit: int | None = None, log: Callable[[str], None] | None = None,
    wave_rows: int = WAVE_ROWS, min_waves: int = 1,
) -> dict:
    """Embeds the rows of ``texts`` (key, text) that the table at ``output`` lacks, adds them and returns the manifest.

    ``log`` is told of every wave when it has committed: rows, tokens and cost so far. A run that stops, at whatever step, is
    gone on with by the next one with the same settings (and the same input file); one with others raises. Rows that a request has
    failed for raise ``EmbeddingFailed`` at the end of their wave, and are asked for again by the next run.
    """
    check_budget(max_tokens, timeout)
    check_output(output, limit)
    tell = log or (lambda line: print(line, file=sys.stderr))
    began, at = time.time(), paths_of(output)
    known = input_path is not None and shared.exists(spark, input_path)
    source = shared.tree_hash(spark, input_path) if known else {"sha256": None, "files": None, "bytes": None}
    settings = {
        "model": getattr(embedder, "model", type(embedder).__name__), "dimensions": embedder.dimensions, "key": key, "input_path": input_path, "input_sha256": source["sha256"], "limit": limit,
        "max_inputs_per_request": max_inputs, "max_estimated_tokens_per_request": max_tokens, "request_timeout_seconds": timeout,
    }
    rows = texts.count()
    finished = vectors_at(spark, output)
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}[key]
    table = f"{key} {kind}, embedding array<float>, request bigint, estimated_tokens bigint, prompt_tokens bigint, total_tokens bigint"
    columns = [c.split()[0] for c in table.split(", ")]

    def staged(waves: list[int]) -> DataFrame:
        empty = spark.createDataFrame([], table)
        return spark.read.schema(table).parquet(*[f"{at['staging']}/wave={w}" for w in waves]) if waves else empty

    found = shared.read_json(spark, at["checkpoint"])
    if found is None:
        shared.delete(spark, at["staging"])
    done = committed_waves(spark, at["staging"])
    have = staged(done).agg(F.count("*").alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens")).first()
    if found is not None:
        check_checkpoint(found, settings, have.n, rows)
    shared.write_json(spark, settings | {"product_count": rows, "waves": done}, at["checkpoint"])
    already = have.n + (finished.count() if finished is not None else 0)
    left = guarded(missing(missing(texts, finished, key), staged(done) if done else None, key), key).select(key, "text")
    n, tokens = already, have.tokens
    if already < rows:
        pending = write_pending(left, at["pending"], max(min_waves, -(-(rows - already) // wave_rows)))
        first = max(done, default=-1) + 1
        text_schema = left.schema
        for i, folder in enumerate(pending):
            seen = Observation()
            fresh = embedded(spark.read.schema(text_schema).parquet(folder), embedder, key, max_inputs, max_tokens, timeout, errors=True)
            fresh = fresh.observe(
                seen, F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("error"),
                F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens"),
            )
            fresh.filter("error is null").select(*columns).write.mode("overwrite").parquet(f"{at['staging']}/wave={first + i}")
            told = seen.get
            n, tokens, done = n + told["rows"], tokens + told["tokens"], [*done, first + i]
            shared.write_json(spark, settings | {"product_count": rows, "waves": done}, at["checkpoint"])
            tell(f"wave {i + 1} of {len(pending)}: {n:,} of {rows:,} rows ({100 * n / max(1, rows):.1f}%), {tokens:,} tokens, ${tokens / 1e6 * PRICE_PER_MILLION:.4f}, {time.time() - began:.0f} s")
            if told["failed"]:
                raise EmbeddingFailed(f"{told['failed']} rows of wave {first + i} have no vector ({told['error']}); {n} of {rows} rows are kept")
        shared.delete(spark, at["pending"])
    # What will be there is checked as a whole before any of it is published.
    whole = staged(done) if finished is None else finished.select(*columns).unionByName(staged(done))
    check_whole(whole, key, embedder.dimensions, rows, at["staging"])
    if done:
        runs = [int(name.removeprefix("run=")) for name in shared.folders(spark, output) if name.startswith("run=")]
        shared.rename(spark, at["staging"], f"{output.rstrip('/')}/run={max(runs, default=0) + 1}")
    whole = vectors_at(spark, output)
    if whole is None:  # an input without rows
        staged([]).write.parquet(f"{output.rstrip('/')}/run=1/wave=0")
        whole = staged([])
    used = whole.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("p"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("t")).first()
    made = shared.tree_hash(spark, output)
    manifest = manifest_of(
        settings["model"], embedder.dimensions, rows, used.p, time.time() - began, total_tokens=used.t, output_path=output, output_sha256=made["sha256"], output_files=made["files"],
        output_bytes=made["bytes"], input_files=source["files"], input_bytes=source["bytes"], vectors_digest=digest(whole, key),
        texts_digest=digest(texts.select(key, F.col("text").alias("embedding")), key), spark_version=spark.version, numpy_version=version_of("numpy"),
        **{k: settings[k] for k in COMPARED if k not in ("model", "dimensions", "key")},
    )
    shared.write_json(spark, manifest, manifest_path or at["manifest"])
    shared.delete(spark, at["checkpoint"])
    return manifest


def check_whole(vectors: DataFrame, key: str, dimensions: int, rows: int, where: str) -> None:
    """Raises unless there is one unit vector of ``dimensions`` for each of ``rows`` keys."""
    found = audit(vectors, dimensions)
    if found["not_unit"] or found["other_size"]:
        raise ValueError(f"the vectors at {where} are not unit vectors of {dimensions}: {found}")
    if found["rows"] != rows or vectors.select(key).distinct().count() != rows:
        raise ValueError(f"the vectors at {where} are not whole: {found}, {rows} texts")
