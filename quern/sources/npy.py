"""Dense float matrices in .npy files as a Spark data source.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").load(path)  # row_index, embedding
    write_npy(vectors, path, dimensions)

The header is read on the driver; every partition maps its own rows, to read as to write.
Files lie on a file system that driver and executors share. Parquet is the native form; this
is for exchange.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quern.sources.files import renumbered

SCHEMA = "row_index bigint, embedding array<float>"


class Rows(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        matrix = np.load(self.path, mmap_mode="r", allow_pickle=False)
        if matrix.ndim != 2 or matrix.dtype != np.float32:
            raise ValueError(f"{self.path} holds {matrix.dtype} of shape {matrix.shape}, not rows of float32")
        n = matrix.shape[0]
        return [Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        matrix = np.load(self.path, mmap_mode="r", allow_pickle=False)
        for a in range(part.first, part.end, 4096):
            block = np.ascontiguousarray(matrix[a : min(part.end, a + 4096)])
            n, d = block.shape
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(block.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n, dtype=np.int64)), vectors], ["row_index", "embedding"])


class Written(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class NpyWriter(DataSourceArrowWriter):
    """Every task maps the partial file and sets its own rows, so a repeated task sets the same ones;
    the file gets its name when all rows are there."""

    def __init__(self, path: str, rows: int, dimensions: int):
        self.path, self.rows, self.partial = path, rows, f"{path}.partial"
        np.lib.format.open_memmap(self.partial, mode="w+", dtype=np.float32, shape=(rows, dimensions)).flush()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        matrix = np.lib.format.open_memmap(self.partial, mode="r+")
        n = 0
        for batch in iterator:
            at = batch.column("row_index").to_numpy()
            matrix[at] = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            n += len(at)
        matrix.flush()
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        if (n := sum(m.rows for m in messages if m)) != self.rows:
            raise ValueError(f"{n} rows were written of {self.rows}")
        os.replace(self.partial, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.partial):
            os.remove(self.partial)


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"].removeprefix("file://"), int(self.options["matrix_rows"]), int(self.options["dimensions"]))

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"].removeprefix("file://"), int(self.options.get("rows", 65_536)))


def shape_of(path: str) -> tuple[int, int]:
    """Rows and columns of a matrix, from its header."""
    matrix = np.load(path.removeprefix("file://"), mmap_mode="r", allow_pickle=False)
    if matrix.ndim != 2 or matrix.dtype != np.float32:
        raise ValueError(f"{path} holds {matrix.dtype} of shape {matrix.shape}, not rows of float32")
    return matrix.shape


def with_rows(df: DataFrame, path: str, place: str = "row_index", name: str = "embedding") -> DataFrame:
    """``df`` with ``name``: the matrix row at each row's ``place``, taken by the task that has the row. Nothing is shuffled;
    a place beyond the matrix raises."""
    at = path.removeprefix("file://")
    carried = [c for c in df.columns if c != name]
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{place}`").cast("bigint").alias("at"))
    kind = given.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(at, mmap_mode="r", allow_pickle=False)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                rows = part.column("at").to_numpy()
                if len(rows) and not 0 <= rows.min() <= rows.max() < len(matrix):
                    raise IndexError(f"row {rows.max()} of {len(matrix)} at {at}")
                block = np.ascontiguousarray(matrix[rows])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(block.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("row"), vectors], ["row", "vector"])

    return given.mapInArrow(run, f"row {kind}, vector array<float>").select("row.*", F.col("vector").alias(name))


def write_npy(vectors: DataFrame, path: str, dimensions: int, order: str = "row_index") -> int:
    """Rows of ``vectors`` (order, embedding) as one float32 file in order; returns their number.

    Rows go to their places: by ``order`` itself where that counts them from 0, else by their
    rank in it. No row passes through the driver.
    """
    spark = vectors.sparkSession
    spark.dataSource.register(NpyDataSource)
    rows = vectors.select(F.col(order).cast("bigint").alias("row_index"), F.col("embedding").cast("array<float>").alias("embedding"))
    n, low, high, kinds = rows.agg(F.count("*"), F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()
    if n and (low, high, kinds) != (0, n - 1, n):
        rows = renumbered(rows.withColumnRenamed("row_index", "at"), "at", "row_index")
    rows.select("row_index", "embedding").write.format("npy").option("matrix_rows", n).option("dimensions", dimensions).mode("append").save(path)
    return n
