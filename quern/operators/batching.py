"""Batching: requests bounded by inputs and tokens.

``batch_ids`` numbers the batches of next-fit over all rows in one order, without a task that sees them
all. Where a batch begins decides where the next one does, so a block of rows is a function of
the batch that is open when it begins. It is known from one small summary: of that open batch only matters how many
of the block's first rows it still takes, at most ``max_inputs``; for each of these starts the summary says how many batches begin in
the block and which one is open at its end (next starts by binary search in prefix sums, followed to the
end by pointer jumping). Summaries are composed within each range of the order by tasks, and over the ranges, of which there are as
many as partitions, on the driver. With the batch that is open where it begins, every block is
then numbered by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, stash

MAX_INPUT_TOKENS, MAX_REQUEST_TOKENS = 8192, 300_000
MAX_INPUTS, MAX_TOKENS = 256, 200_000
#: Rows of a block, and entries of blocks and ranges that are broadcast.
BLOCK_ROWS, BROADCAST_BLOCKS = 1 << 16, 100_000


def check_budget(max_tokens: int, timeout: float) -> None:
    if timeout <= 0:
        raise ValueError("the timeout must be positive")
    if max_tokens > MAX_REQUEST_TOKENS:
        raise ValueError(f"a request holds at most {MAX_REQUEST_TOKENS} tokens")


class NextFit:
    """Batch numbers in order: a new batch where the open one is full or the tokens do not fit."""

    def __init__(self, max_inputs: int, max_tokens: int):
        self.limits = max_inputs, max_tokens
        self.batch = self.count = self.tokens = 0

    def place(self, tokens: int) -> int:
        if self.count >= self.limits[0] or (self.count and self.tokens + tokens > self.limits[1]):
            self.batch, self.count, self.tokens = self.batch + 1, 0, 0
        self.count += 1
        self.tokens += tokens
        return self.batch


# --- blocks as functions of the open batch -----------------------------------------------


def next_starts(tokens: np.ndarray, max_inputs: int, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each row the first row after a batch that begins there, len(tokens) at most; prefix sums of ``tokens``)."""
    n = len(tokens)
    before = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(n)
    full = np.searchsorted(before, before[:-1] + max_tokens, side="right") - 1
    return np.minimum(np.minimum(np.maximum(full, at + 1), at + max_inputs), n), before


@dataclass
class Summary:
    """A stretch of rows. ``heads``: prefix sums of its first rows, at most max_inputs of them; for an open batch that takes
    its first m rows (m a place in the lists) ``begun`` batches begin in it, and the last has ``count`` rows and ``tokens``.
    Where ``rows`` rows are fewer than max_inputs, a batch may take them all: m = rows begins none."""

    rows: int
    heads: np.ndarray
    begun: np.ndarray
    count: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, max_inputs: int, max_tokens: int) -> Summary:
        n = len(tokens)
        jump, before = next_starts(tokens, max_inputs, max_tokens)
        # Pointer jumping: the last start from each row on, and how many lie between; a batch that is open at the end stays.
        last = np.arange(n)
        go = np.where(jump < n, jump, last)
        steps = (jump < n).astype(np.int64)
        while (go != go[go]).any():
            steps, go = steps + steps[go], go[go]
        starts = np.arange(min(n, max_inputs + 1))
        last = go[starts]
        return cls(n, before[1 : max_inputs + 1], steps[starts] + 1, n - last, before[n] - before[last])

    def after(self, count: int, tokens: int, limits: tuple[int, int]) -> tuple[int, int, int]:
        """(batches begun, rows and tokens of the open one at the end) where one with ``count`` rows and ``tokens`` is open at the
        beginning; none is with 0."""
        if not self.rows:
            return 0, count, tokens
        m = taken(self.heads, count, tokens, limits)
        if m == self.rows:
            return 0, count + m, tokens + int(self.heads[m - 1])
        return int(self.begun[m]), int(self.count[m]), int(self.tokens[m])

    def then(self, other: Summary, limits: tuple[int, int]) -> Summary:
        """Both stretches as one."""
        if not self.rows or not other.rows:
            return other if not self.rows else self
        ends: dict[tuple[int, int], tuple[int, int, int]] = {}
        begun, count, tokens = [], [], []
        starts = min(self.rows + other.rows, limits[0] + 1)
        for m in range(starts):
            if m < len(self.begun) and m < self.rows:
                at = int(self.count[m]), int(self.tokens[m])
                if at not in ends:
                    ends[at] = other.after(*at, limits)
                b, c, t = ends[at]
                b += int(self.begun[m])
            else:  # the first m rows reach into the other stretch, where the next batch begins
                k = m - self.rows
                b, c, t = int(other.begun[k]), int(other.count[k]), int(other.tokens[k])
            begun.append(b)
            count.append(c)
            tokens.append(t)
        total = int(self.heads[-1]) if self.rows <= limits[0] else 0
        heads = self.heads if len(self.heads) >= limits[0] else np.concatenate([self.heads, other.heads + total])[: limits[0]]
        return Summary(self.rows + other.rows, heads, np.array(begun), np.array(count), np.array(tokens))

    def packed(self) -> bytes:
        sizes = np.array([self.rows, len(self.heads), len(self.begun)], "<i8")
        return b"".join(a.astype("<i8").tobytes() for a in (sizes, self.heads, self.begun, self.count, self.tokens))

    @classmethod
    def unpacked(cls, data: bytes) -> Summary:
        a = np.frombuffer(data, "<i8")
        rows, h, n = (int(x) for x in a[:3])
        cut = np.cumsum([3, h, n, n, n])
        return cls(rows, *(a[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)))


def taken(heads: np.ndarray, count: int, tokens: int, limits: tuple[int, int]) -> int:
    """How many of the next rows a batch with ``count`` rows and ``tokens`` takes; none if there is no batch yet."""
    if not count:
        return 0
    return int(min(limits[0] - count, np.searchsorted(heads, limits[1] - tokens, side="right"), len(heads)))


def numbered(tokens: np.ndarray, count: int, open_tokens: int, open_batch: int, limits: tuple[int, int]) -> np.ndarray:
    """The batch of every row of a block: ``open_batch`` while it takes them, and then the next numbers."""
    n = len(tokens)
    jump, before = next_starts(tokens, *limits)
    first = taken(before[1 : limits[0] + 1], count, open_tokens, limits)
    starts, at, follow = [], first, jump.tolist()
    while at < n:
        starts.append(at)
        at = follow[at]
    begins = np.zeros(n, np.int64)
    begins[starts] = 1
    return open_batch + np.cumsum(begins)


# --- tables ------------------------------------------------------------------------------


def _blocks(slim: DataFrame, block_rows: int, limits: tuple[int, int]) -> DataFrame:
    """part, block, summary, keys, tokens: ranges of the order, and in each its rows in order, ``block_rows`` to a row. Rows that
    agree in order and tokens can change places, so a key of many rows is dealt out like others."""
    kind = slim.schema["order"].dataType.simpleString()
    ranged = slim.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("order", "tokens", "tie").sortWithinPartitions("order", "tokens").drop("tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, rows, block = TaskContext.get().partitionId(), [], 0, 0

        def out(table: pa.Table) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("order", "tokens")]
            summary = Summary.of(table.column("tokens").to_numpy(), *limits).packed()
            arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([summary], pa.binary()), *lists]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "summary", "keys", "tokens"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= block_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                yield out(table.slice(0, block_rows).combine_chunks())
                block += 1
                rest = table.slice(block_rows)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return ranged.mapInArrow(run, f"part int, block int, summary binary, keys array<{kind}>, tokens array<bigint>")


def batch_ids(df: DataFrame, order: str, tokens: str, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """order, tokens and batch of every row: next-fit over all rows in the order of ``order`` (nulls first, equal ones by
    tokens), batches numbered from 0. Null tokens count as 0. An empty table gives an empty one.
    """
    limits = max_inputs, max_tokens
    if max_inputs < 1:
        raise ValueError("a batch holds at least one input")
    slim = df.select(F.col(order).alias("order"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("tokens"))
    kind = slim.schema["order"].dataType.simpleString()
    # Read from a table, equal rows are numbered alike whenever a task is repeated.
    slim = stash(slim, "fit-rows")
    blocks = stash(_blocks(slim, max(block_rows, max_inputs), limits), "fit-blocks")
    discard(slim)
    summaries = blocks.select("part", "block", "summary")

    def in_order(table: pa.Table) -> Iterator[tuple[int, Summary]]:
        for row in sorted(table.select(["block", "summary"]).to_pylist(), key=lambda r: r["block"]):
            yield row["block"], Summary.unpacked(row["summary"])

    def composed(table: pa.Table) -> pa.Table:
        whole = None
        for _, s in in_order(table):
            whole = s if whole is None else whole.then(s, limits)
        return pa.table({"part": table.column("part").slice(0, 1), "blocks": pa.array([table.num_rows], pa.int64()), "summary": pa.array([whole.packed()], pa.binary())})

    # A row for each partition, of at most max_inputs numbers in four lists.
    ranges = summaries.groupBy("part").applyInArrow(composed, "part int, blocks bigint, summary binary").collect()
    entries, state, batch = [], (0, 0), -1
    for r in sorted(ranges, key=lambda r: r.part):
        entries.append((r.part, *state, batch))
        begun, *state = Summary.unpacked(bytes(r.summary)).after(*state, limits)
        batch += begun
    opened = "count bigint, open_tokens bigint, batch bigint"
    given = df.sparkSession.createDataFrame(entries, f"part int, {opened}")

    def entered(table: pa.Table) -> pa.Table:
        """What is open at the beginning of each block of a range."""
        count, held, batch = (table.column(c)[0].as_py() for c in ("count", "open_tokens", "batch"))
        rows = []
        for block, s in in_order(table):
            rows.append((block, count, held, batch))
            begun, count, held = s.after(count, held, limits)
            batch += begun
        columns = dict(zip(("block", "count", "open_tokens", "batch"), map(list, zip(*rows, strict=True)), strict=True))
        out = {"part": pa.array([table.column("part")[0].as_py()] * len(rows), pa.int32()), "block": pa.array(columns.pop("block"), pa.int32())}
        return pa.table(out | {c: pa.array(v, pa.int64()) for c, v in columns.items()})

    starts = summaries.join(F.broadcast(given), "part").groupBy("part").applyInArrow(entered, f"part int, block int, {opened}")
    if sum(r.blocks for r in ranges) <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, values = (b.column(c)[i].values for c in ("keys", "tokens"))
                found = numbered(values.to_numpy(), *(b.column(c)[i].as_py() for c in ("count", "open_tokens", "batch")), limits)
                yield pa.RecordBatch.from_arrays([keys, values, pa.array(found)], ["order", "tokens", "batch"])

    placed = blocks.join(starts, ["part", "block"]).select("keys", "tokens", "count", "open_tokens", "batch")
    return placed.mapInArrow(run, f"order {kind}, tokens bigint, batch bigint").withColumnsRenamed({"order": order, "tokens": tokens})
