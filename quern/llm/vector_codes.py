"""Compression of vectors to short codes: a codebook per part of a vector, fitted by Lloyd's rounds with heaps.

Components become whole numbers, vectors are cut into equal parts, and each part is named by the
nearest entry of its position's codebook. The first round measures every part against every entry.
After it a block of vectors keeps, for every entry, a heap of the parts that have it, keyed by lower
bound (to the second nearest entry) minus upper bound (to its own). When entries move, the slack of all
parts of an entry shrinks by at most its own drift plus the largest drift of the others, so one sum per entry stands
for all of them: parts are popped while their key lies below the cumulative drift, and only these are
measured again, against all entries and exactly.

Blocks and their heaps are rows of a table in the shared folder, written once a round and worked on by
the task that reads them. Only sums per entry (entries x components of numbers, whatever the
table's size) are shuffled and meet on the driver, where entries are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import discard, stash


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64  # at most 256, a byte of the code each
    rounds: int = 2
    scale: int = 256
    block_bytes: int = 2 << 20  # of a block's components
    broadcast_labels: int = 100_000  # sums of labels are broadcast up to this many


# --- one block ---------------------------------------------------------------------------


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, entries): squared distances of parts to the entries of their position, exact. Where all numbers
    stay below 2**53 a float product has them exactly, and is faster than one of integers."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * book.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part (ties to the lower index), and a bound that its slack does not fall below."""
    d = squared(x, book)
    entry = d.argmin(axis=1)
    if d.shape[1] == 1:
        return entry, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return entry, two[:, 1] - two[:, 0] - 1e-12 * (two[:, 0] + two[:, 1])


class Block:
    """Vectors of one block: parts (n, positions, size), the entry of each part, a heap of (key, row) per
    position and entry, and the sums of components and counts of each entry's parts."""

    def __init__(self, parts: np.ndarray, entry: np.ndarray, heaps: list[list[tuple[float, int]]], sums: np.ndarray, counts: np.ndarray):
        self.parts, self.entry, self.heaps, self.sums, self.counts = parts, entry, heaps, sums, counts
        self.measured = 0

    @classmethod
    def first(cls, parts: np.ndarray, books: np.ndarray) -> Block:
        """Every part measured against every entry."""
        n, positions, size = parts.shape
        entries = books.shape[1]
        made = cls(parts, np.zeros((n, positions), np.uint8), [[] for _ in range(positions * entries)], np.zeros((positions, entries, size), np.int64), np.zeros((positions, entries), np.int64))
        for p in range(positions):
            entry, slack = nearest(parts[:, p], books[p])
            made.entry[:, p] = entry
            for row, (e, key) in enumerate(zip(entry.tolist(), slack.tolist(), strict=True)):
                made.heaps[p * entries + e].append((key, row))
            np.add.at(made.sums[p], entry, parts[:, p])
            made.counts[p] += np.bincount(entry, minlength=entries)
        for heap in made.heaps:
            heapify(heap)
        made.measured = n * positions
        return made

    def again(self, books: np.ndarray, drift: np.ndarray, moved: np.ndarray) -> None:
        """Entries now stand as in ``books``, and ``drift`` has the cumulative drift of each. Parts whose bounds it
        has violated are popped and measured; positions without a ``moved`` entry are as they were."""
        entries = books.shape[1]
        self.measured = 0
        for p in np.flatnonzero(moved).tolist():
            popped: list[int] = []
            for e in range(entries):
                heap, limit = self.heaps[p * entries + e], drift[p, e] * (1 + 1e-12) + 1e-9
                while heap and heap[0][0] <= limit:
                    popped.append(heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            x, old = self.parts[rows, p], self.entry[rows, p].astype(np.int64)
            entry, slack = nearest(x, books[p])
            for row, e, key in zip(popped, entry.tolist(), (slack + drift[p, entry]).tolist(), strict=True):
                heappush(self.heaps[p * entries + e], (key, row))
            changed = entry != old
            self.entry[rows, p] = entry
            np.add.at(self.sums[p], entry[changed], x[changed])
            np.subtract.at(self.sums[p], old[changed], x[changed])
            self.counts[p] += np.bincount(entry[changed], minlength=entries) - np.bincount(old[changed], minlength=entries)
            self.measured += len(rows)

    def errors(self, books: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to the entries it has, summed over its parts."""
        total = np.zeros(len(self.parts), np.int64)
        for p in range(self.parts.shape[1]):
            gap = self.parts[:, p].astype(np.int64) - books[p][self.entry[:, p]]
            total += (gap * gap).sum(axis=1)
        return total

    def packed(self) -> dict[str, bytes]:
        """Columns of a row; a heap stays in the order it has."""
        keys, rows = zip(*[(k, r) for heap in self.heaps for k, r in heap], strict=True) if len(self.parts) else ((), ())
        arrays = {
            "parts": self.parts.astype("<i4"), "entry": self.entry, "heap_sizes": np.array([len(h) for h in self.heaps], "<i4"), "heap_keys": np.array(keys, "<f8"),
            "heap_rows": np.array(rows, "<i4"), "sums": self.sums.astype("<i8"), "counts": self.counts.astype("<i8"),
        }
        return {name: a.tobytes() for name, a in arrays.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], positions: int, entries: int, size: int) -> Block:
        parts = np.frombuffer(row["parts"], "<i4").reshape(-1, positions, size)
        keys, rows = np.frombuffer(row["heap_keys"], "<f8").tolist(), np.frombuffer(row["heap_rows"], "<i4").tolist()
        heaps, at = [], 0
        for n in np.frombuffer(row["heap_sizes"], "<i4").tolist():
            heaps.append(list(zip(keys[at : at + n], rows[at : at + n], strict=True)))
            at += n
        sums = np.frombuffer(row["sums"], "<i8").reshape(positions, entries, size).copy()
        counts = np.frombuffer(row["counts"], "<i8").reshape(positions, entries).copy()
        return cls(parts, np.frombuffer(row["entry"], np.uint8).reshape(-1, positions).copy(), heaps, sums, counts)


# --- rounds ------------------------------------------------------------------------------

BINARY = ("parts", "entry", "heap_sizes", "heap_keys", "heap_rows", "sums", "counts")


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def reach_of(size: int) -> int:
    """The largest number that a component may become: squared distances of parts stay within 62 bits, and a part within 31."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // size) // 2)


def whole_numbers(batch: pa.RecordBatch, dims: int, p: CodeParams) -> tuple[np.ndarray, np.ndarray]:
    """(which rows fit, their components as whole numbers): a row fits that has ``dims`` components within reach."""
    column = batch.column("vector")
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    fits = np.diff(offsets) == dims
    values = np.floor(flat[(offsets[:-1][fits][:, None] + np.arange(dims)[None, :])].astype(np.float64) * p.scale)
    near = (np.abs(values) <= reach_of(dims // p.parts)).all(axis=1)
    at = np.flatnonzero(fits)
    fits[at[~near]] = False
    return fits, values[near].astype(np.int32)


def _first_round(vectors: DataFrame, books: np.ndarray, dims: int, p: CodeParams) -> DataFrame:
    """A row per block of at most block_bytes. Rows that do not fit go along in ``odd_keys`` and ``odd_labels``."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows_at_once = max(1, p.block_bytes // (4 * dims))
    ddl = f"keys array<{types['key']}>, labels array<{types['label']}>, odd_keys array<{types['key']}>, odd_labels array<{types['label']}>, measured bigint, " + ", ".join(f"{c} binary" for c in BINARY)

    def as_list(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                # take() gives arrays of their own, whose offsets begin at 0
                batch = whole.slice(at, rows_at_once).take(pa.array(np.arange(min(rows_at_once, whole.num_rows - at))))
                fits, values = whole_numbers(batch, dims, p)
                block = Block.first(values.reshape(len(values), p.parts, dims // p.parts), books)
                kept, odd = pa.array(np.flatnonzero(fits)), pa.array(np.flatnonzero(~fits))
                lists = [as_list(batch.column(c).take(of)) for of in (kept, odd) for c in ("key", "label")]
                arrays = [*lists, pa.array([block.measured], pa.int64()), *[pa.array([b], pa.binary()) for b in block.packed().values()]]
                yield pa.RecordBatch.from_arrays(arrays, ["keys", "labels", "odd_keys", "odd_labels", "measured", *BINARY])

    return vectors.mapInArrow(run, ddl)


def _next_round(blocks: DataFrame, books: np.ndarray, drift: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The blocks, with the parts whose bounds are violated measured again."""
    positions, entries, size = books.shape
    at = blocks.columns.index

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block.unpacked({c: row.column(c)[0].as_py() for c in BINARY}, positions, entries, size)
                block.again(books, drift, moved)
                new = {c: pa.array([b], pa.binary()) for c, b in block.packed().items()} | {"measured": pa.array([block.measured], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, row.column(at(c))) for c in batch.schema.names], batch.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def _entry_sums(blocks: DataFrame, positions: int, entries: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry over all blocks: a task sends at most a row for each entry."""
    names = ["n", *[f"s{i}" for i in range(size)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, size + 1), np.int64)
        for batch in batches:
            for sums, counts in zip(batch.column("sums"), batch.column("counts"), strict=True):
                total[:, 0] += np.frombuffer(counts.as_py(), "<i8")
                total[:, 1:] += np.frombuffer(sums.as_py(), "<i8").reshape(-1, size)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(total[used, i]) for i in range(size + 1)]], ["slot", *names])

    parts = blocks.select("sums", "counts").mapInArrow(run, "slot bigint, " + ", ".join(f"{c} bigint" for c in names))
    sums, counts = np.zeros((positions * entries, size), np.int64), np.zeros(positions * entries, np.int64)
    for row in parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).collect():
        counts[row.slot], sums[row.slot] = row.n, row[2:]
    return sums.reshape(positions, entries, size), counts.reshape(positions, entries)


def replaced(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new entries, what each part's slack loses by the move, which positions moved). Entries without parts stay."""
    new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    own = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2))
    largest, most = own.argmax(axis=1), own.max(axis=1)
    rest = own.copy()
    rest[np.arange(len(own)), largest] = 0
    others = np.repeat(most[:, None], own.shape[1], axis=1)
    others[np.arange(len(own)), largest] = rest.max(axis=1)
    return new, own + others, most > 0


@dataclass(frozen=True)
class Codes:
    """``rows``: key, label, code and error of every usable vector; ``books``: (positions, entries, size); ``measured``: the
    parts that were measured against all entries, round by round."""

    rows: DataFrame
    books: np.ndarray
    measured: list[int]


def fit(vectors: DataFrame, p: CodeParams = CodeParams(), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> Codes:
    """Codebooks after ``rounds`` rounds, and the codes by them.

    Rows whose vector is null, or holds a null or a component that is not finite, are dropped. The first
    entries are the parts of the ``entries`` rows with the smallest keys (null keys last, equal keys by
    vector; all rows where there are fewer). The number of components is that of the smallest key's vector and
    must be a multiple of ``parts``; a vector of another length, or with a component beyond 2**31 / scale, has null code and error,
    and where most are such it raises. Repeated rows each have their code. An empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    if not 1 <= p.entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    slim = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")).filter(usable(F.col("vector")))
    firsts = slim.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(p.entries)
    firsts = [np.floor(np.array(r.vector, np.float64) * p.scale) for r in firsts.collect()]
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    codes_ddl = f"key {types['key']}, label {types['label']}, code string, error bigint"
    if not firsts:
        return Codes(slim.sparkSession.createDataFrame([], codes_ddl), np.zeros((p.parts, 0, 0), np.int64), [])
    dims = len(firsts[0])
    if not dims or dims % p.parts:
        raise ValueError(f"{dims} components cannot be cut into {p.parts} equal parts")
    size = dims // p.parts
    seeds = [v.astype(np.int64) for v in firsts if len(v) == dims and np.abs(v).max() <= reach_of(size)]
    if not seeds:
        raise ValueError(f"none of the first vectors has {dims} components within reach")
    books = np.ascontiguousarray(np.stack(seeds).reshape(len(seeds), p.parts, size).transpose(1, 0, 2))
    entries = len(seeds)

    blocks = stash(_first_round(slim, books, dims, p), "code-blocks")
    told = blocks.agg(F.sum("measured").alias("m"), F.sum(F.size("odd_keys")).alias("odd"), F.sum(F.size("keys")).alias("kept")).first()
    if told.odd > told.kept:
        raise ValueError(f"{told.odd} of {told.odd + told.kept} vectors do not have {dims} components within reach, as the smallest key's has")
    measured, drift, moved = [told.m], np.zeros((p.parts, entries)), np.zeros(p.parts, bool)
    for done in range(p.rounds):
        if done:  # the last assignment stands in the rows alone
            made = stash(_next_round(blocks, books, drift, moved), "code-blocks")
            discard(blocks)
            blocks = made
            measured.append(blocks.agg(F.sum("measured")).first()[0])
        books, lost, moved = replaced(books, *_entry_sums(blocks, p.parts, entries, size))
        drift = drift + lost

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block.unpacked({c: row.column(c)[0].as_py() for c in BINARY}, p.parts, entries, size)
                block.again(books, drift, moved)
                n, odd = len(block.parts), len(row.column("odd_keys")[0])
                texts = [block.entry[r].tobytes().hex() for r in range(n)]
                arrays = [pa.concat_arrays([row.column(c).flatten(), row.column(f"odd_{c}").flatten()]) for c in ("keys", "labels")]
                arrays += [pa.array(texts + [None] * odd, pa.string()), pa.array([*block.errors(books).tolist(), *[None] * odd], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "label", "code", "error"])

    rows = stash(blocks.mapInArrow(run, codes_ddl), "codes")
    discard(blocks)
    return Codes(rows, books, measured)


def with_label_errors(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with label_error: their error summed over equal labels, nulls together.

    Sums are made with a partial aggregate. Up to ``limit`` labels go to all tasks; of more, those with at
    least a thousandth of the rows (a thousand at most) do, and the rest, none of which is large, are joined by
    a shuffle.
    """
    sums = stash(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    labels, total = sums.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    shown = [*rows.columns, "label_error"]
    if labels <= limit:
        return rows.join(F.broadcast(sums), same).select(*shown)
    large = F.broadcast(sums.filter(F.col("_n") * 1000 >= total))
    rest = rows.join(large, same, "left_anti").join(sums.filter(F.col("_n") * 1000 < total), same)
    return rows.join(large, same).select(*shown).unionByName(rest.select(*shown))


def digest(books: np.ndarray) -> str:
    """The sha256 of all entries' components as decimals, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame, p: CodeParams = CodeParams()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    found = fit(vectors, p)
    rows = with_label_errors(found.rows, p.broadcast_labels)
    return rows.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(found.books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    dot = "list_inner_product({0}::double[], {1}::double[])"
    gap = f"({dot.format('x', 'x')} - 2 * {dot.format('x', 'c')} + {dot.format('c', 'c')})::bigint"
    out = []
    for i in range(3):
        out.append(f"a{i} AS (SELECT rid, p, x, min({gap} * 64 + e) AS m FROM x JOIN c{i} USING (p) GROUP BY rid, p, x)")
        if i < 2:
            out.append(f"""n{i} AS (SELECT p, e, list(v ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(v)::double / count(*))::bigint AS v
  FROM (SELECT p, m % 64 AS e, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e),
c{i + 1} AS (SELECT c{i}.p, c{i}.e, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} ON c{i}.p = n{i}.p AND c{i}.e = n{i}.e)""")
    return ",\n".join(out)


ORACLE_SQL = f"""WITH k AS (SELECT vec_id, label, embedding, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id, embedding) AS rid, len(v) // 16 AS s FROM k),
x AS (SELECT rid, q.p, v[q.p * s + 1:(q.p + 1) * s] AS x FROM r, (SELECT unnest(range(16)) AS p) q),
c0 AS (SELECT p, rid - 1 AS e, x AS c FROM x WHERE rid <= 64),
{_rounds_sql()},
f AS (SELECT rid, string_agg(printf('%02x', (m % 64)::int), '' ORDER BY p) AS code, sum(m // 64)::bigint AS error FROM a2 GROUP BY rid),
b AS (SELECT sha256(string_agg(v::varchar, ',' ORDER BY p, e, j)) AS books FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS j FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, books AS codebooks_sha256 FROM f JOIN r USING (rid), b"""
