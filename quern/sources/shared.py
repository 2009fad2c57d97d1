"""Small files, folders and file hashes on the file system that driver and executors share, through Hadoop's API."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none where it is not there."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path``, sorted; none where it is not there."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile()) if fs.exists(where) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or folder, whose new parents are made; raises where ``to`` is there already, or the move fails."""
    fs, where = _at(spark, path)
    target = _at(spark, to)[1]
    if fs.exists(target):
        raise FileExistsError(f"{path} cannot be moved to {to}: it is there")
    fs.mkdirs(target.getParent())
    if not fs.rename(where, target):
        raise OSError(f"{path} cannot be moved to {to}")


def replace(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file to a name that another file may have: the file system does it in one step, so that at any time the name
    is that of the old or of the new one."""
    jvm = spark._jvm
    source, target = (_at(spark, p)[0].makeQualified(_at(spark, p)[1]) for p in (path, to))
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a small file; None where there is none."""
    if not exists(spark, path):
        return None
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, written under another name and put in place in one step: a reader sees the old file or the new one."""
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    fs, where = _at(spark, partial)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        replace(spark, partial, path)
    except Exception:
        fs.delete(where, False)
        raise


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2, sort_keys=True) + "\n", path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file at ``path`` (a file, or a folder with all below it but names that begin with
    _ or .), each hashed by the task that reads it. A file is held whole there, so it has at most 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_hash(spark: SparkSession, path: str) -> dict:
    """sha256, files and bytes of all files at ``path``: a tree over the files' own hashes, whatever their names and
    order. Leaves meet in 256 nodes by their first byte, and only the nodes' hashes come to the driver. A single file has its own hash."""
    leaves = file_hashes(spark, path)
    node = F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256)
    nodes = leaves.groupBy(F.substring("sha256", 1, 2).alias("first")).agg(node.alias("node"), F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("sha256").alias("leaf")).collect()
    files = sum(r.n for r in nodes)
    root = nodes[0].leaf if files == 1 else hashlib.sha256("\n".join(r.node for r in sorted(nodes, key=lambda r: r.first)).encode()).hexdigest()
    return {"sha256": root, "files": files, "bytes": sum(r.bytes for r in nodes)}
