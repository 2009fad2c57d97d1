"""JSON lines, manifests and settings; Markdown reports."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import has_text, strip
from quern.operators.ingest import PRODUCT_COLUMNS
from quern.sources import gzip_members, shared

PRODUCT_DDL = (
    "parent_asin string, title string, store string, average_rating double, rating_number bigint, price double, image_url string, "
    "features array<string>, normalized_title string, retrieval_text string"
)
REQUIRED_MANIFEST_KEYS = {"product_count", "dimensions", "normalized"}
PRICE_PER_MILLION = 0.02


def raw_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``value``: the lines of plain or gzipped files. A gzipped file is read by one task, so its
    lines are dealt out before they are parsed."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else dealt(lines, path)


def dealt(lines: DataFrame, path: str) -> DataFrame:
    """``lines`` in as many partitions as the session has cores at least, where the files at ``path`` are
    gzipped: Spark cannot split those. Rows are dealt out in turn."""
    if not any(f.endswith(".gz") for f in lines.inputFiles()):
        return lines
    return lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def renumbered(df: DataFrame, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``: the rank of every row by the whole number ``order``, from 0. Rows are ranked within
    blocks of ``block`` numbers, and blocks counted within groups of as many; what meets in one task is a row for each group."""
    at = F.floor(F.col(order) / block).cast("bigint")
    sizes = df.groupBy(at.alias("_block")).agg(F.count("*").alias("_rows")).withColumn("_group", F.floor(F.col("_block") / block).cast("bigint"))
    groups = sizes.groupBy("_group").agg(F.sum("_rows").alias("_held"))
    groups = groups.select("_group", (F.sum("_held").over(Window.orderBy("_group")) - F.col("_held")).alias("_before_group"))
    within = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_block")) - F.col("_rows")
    before = sizes.withColumn("_within", within).join(groups, "_group").select("_block", (F.col("_within") + F.col("_before_group")).alias("_before"))
    ranked = df.withColumn("_block", at).withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1)
    return ranked.join(before, "_block").withColumn(name, F.col("_before") + F.col("_rank")).drop("_block", "_rank", "_before")


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """value and row_index: the lines of the files at ``path``, numbered without gaps by file name and place in the file.
    Spark reads larger splits first, so partitions are no guide: a split's lines are counted, and what lies before it is
    added to their places in it. One small row for each split; lines are not shuffled."""
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), at.alias("_at"))
    splits = lines.groupBy("_path", "_start").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_path", "_start")) - F.col("_rows")
    splits = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    return lines.join(F.broadcast(splits), ["_path", "_start"]).select("value", (F.col("_at") + F.col("_shift")).alias("row_index"))


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``raw_lines`` with row_index, their place in the files, by name."""
    return dealt(in_file_order(spark, path), path)


def gzip_lines(spark: SparkSession, path: str, range_bytes: int = gzip_members.RANGE) -> DataFrame:
    """row_index and value of the lines of gzipped files, whose members are inflated by as many tasks as there are
    ranges of ``range_bytes``. Numbering counts the lines of each range first."""
    spark.dataSource.register(gzip_members.GzipMembers)
    lines = spark.read.format("gzip_members").option("bytes", range_bytes).load(path)
    sizes = lines.groupBy("part").agg(F.count("*").alias("_rows"))
    before = sizes.select("part", (F.sum("_rows").over(Window.orderBy("part")) - F.col("_rows")).alias("_before"))
    return lines.join(F.broadcast(before), "part").select((F.col("line") + F.col("_before")).alias("row_index"), "value")


def indexed(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df`` with the place of every row in the order it is read, without gaps: the place within
    its partition, plus the rows of all partitions before (one small row for each)."""
    at = F.monotonically_increasing_id()
    part, within = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    sizes = df.select(part.alias("part")).groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    placed = df.withColumns({"part": part, name: within}).join(F.broadcast(before), "part")
    return placed.withColumn(name, F.col(name) + F.col("before")).drop("part", "before")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Typed product lines; an empty file raises, and so does a line that does not fit the schema when it is read."""
    lines = in_file_order(spark, path).withColumnRenamed("row_index", "line").filter(has_text("value"))
    if lines.isEmpty():
        raise ValueError(f"{path} has no products")
    row = F.from_json("value", f"{PRODUCT_DDL}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    told = F.concat(F.lit(f"{path}, line "), (F.col("line") + 1).cast("string"), F.lit(" is no product"))
    kind = "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in f"{PRODUCT_DDL}, _broken string".split(", ")) + ">"
    wrong = row.isNull() | row["_broken"].isNotNull()
    return lines.select(F.when(wrong, F.raise_error(told).cast(kind)).otherwise(row).alias("r")).select("r.*").drop("_broken")


def placed_products(spark: SparkSession, path: str) -> DataFrame:
    """``read_products`` with row_index, the place of each line in the files by name; none of the lines may be blank, or places
    would not be those of products."""
    lines = in_file_order(spark, path)
    row = F.from_json("value", f"{PRODUCT_DDL}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    kind = "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in f"{PRODUCT_DDL}, _broken string".split(", ")) + ">"
    told = F.concat(F.lit(f"{path}, line "), (F.col("row_index") + 1).cast("string"), F.lit(" is no product"))
    wrong = row.isNull() | row["_broken"].isNotNull() | ~has_text("value")
    return lines.select("row_index", F.when(wrong, F.raise_error(told).cast(kind)).otherwise(row).alias("r")).select("row_index", "r.*").drop("_broken")


def write_products(products: DataFrame, path: str) -> None:
    """JSON lines with nulls kept and fields in order; with a row_index, rows are in its order from file to file."""
    if "row_index" in products.columns:
        products = products.repartitionByRange("row_index").sortWithinPartitions("row_index")
    products.select(*PRODUCT_COLUMNS).write.mode("error").option("ignoreNullFields", "false").json(path)


def product_texts(products: DataFrame, limit: int | None = None) -> DataFrame:
    """row_index, text of the first ``limit`` products; a blank text raises when it is read."""
    rows = products if limit is None else products.filter(F.col("row_index") < limit)
    text = F.when(has_text("retrieval_text"), strip("retrieval_text")).otherwise(
        F.raise_error(F.concat(F.lit("row without retrieval text: "), F.col("row_index").cast("string"))).cast("string")
    )
    return rows.select("row_index", text.alias("text"))


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest at ``path``, on any file system that Spark reads."""
    try:
        found = shared.read_json(spark, path)
    except json.JSONDecodeError as e:
        raise ValueError(f"the manifest at {path} is no JSON: {e}") from None
    if found is None:
        raise ValueError(f"there is no manifest at {path}")
    if not isinstance(found, dict):
        raise ValueError(f"the manifest at {path} is no object")
    if missing := REQUIRED_MANIFEST_KEYS - set(found):
        raise ValueError(f"the manifest lacks {', '.join(sorted(missing))}")
    return found


def check_manifest(manifest: dict, rows: int, dimensions: int) -> None:
    """Counts must be positive whole numbers that agree with the table; normalized must be true itself."""
    for name, have in (("product_count", rows), ("dimensions", dimensions)):
        value = manifest[name]
        if type(value) is not int or value <= 0 or value != have:
            raise ValueError(f"the manifest's {name} is {value!r}, the table has {have}")
    if manifest["normalized"] is not True:
        raise ValueError("the manifest does not say that vectors are normalized")


def manifest_of(model: str, dimensions: int, rows: int, tokens: int, seconds: float, **more) -> dict:
    return {
        "model": model, "dimensions": dimensions, "product_count": rows, "normalized": True, "prompt_tokens": tokens, "total_tokens": tokens,
        "estimated_cost_usd": round(tokens / 1e6 * PRICE_PER_MILLION, 6), "wall_clock_seconds": round(seconds, 3), "created_at": datetime.now(UTC).isoformat(),
    } | more


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file; comments, blank lines and a missing file give nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        return {}
    pairs = (line.strip().removeprefix("export ").partition("=") for line in lines if "=" in line and not line.lstrip().startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


def settings(env: dict[str, str] | None = None, required: bool = False, path: str | None = None) -> dict:
    """Settings of the environment, and of a file at ``path`` for what it lacks; blank values count as
    absent. The key never enters a plan."""
    env = (dotenv(path) if path else {}) | {k: v for k, v in (dict(os.environ) if env is None else env).items() if v.strip()}
    key = (env.get("OPENAI_API_KEY") or "").strip() or None
    if required and key is None:
        raise ValueError("OPENAI_API_KEY is not set")
    return {"api_key": key, "pool": 40, "min_count": 10, "min_average": 4.0}


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small report table as Markdown; vertical bars are escaped. More rows than ``limit`` raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])
