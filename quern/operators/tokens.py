"""Token counts by a tokenizer's own file, where an estimate is not enough."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str, batch: int = 512) -> DataFrame:
    """key, tokens: the length of every text by the ``tokenizers`` file at the path ``tokenizer``, which all
    machines have. A null text has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = tool.encode_batch_fast([t or "" for t in part.column("t").to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(f.ids) for f in found], pa.int64())], [key, "tokens"])

    return df.select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, tokens bigint")
