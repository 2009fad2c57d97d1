"""Vector search: exact top candidates of one query or of a batch."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.vectors import dot

#: Scores are compared and returned with this many decimals, so that ties are the same
#: whatever order a sum was taken in.
SCORE_DECIMALS = 6

#: Bytes of the rows that a worker multiplies at once, and of their scores.
ROW_BYTES, SCORE_BYTES = 4 << 20, 4 << 20
#: Bytes of the query vectors that one worker holds: a batch up to this size goes to all tasks, a larger one is dealt out.
QUERY_BYTES = 64 << 20
#: Bytes of the best rows that tasks may return for a batch that goes to all of them, and of one such row.
FOUND_BYTES, FOUND_ROW = 256 << 20, 20
#: Pairs of a query and a row that one task scores at most, on average.
CELL_PAIRS = 1 << 35


def pool_size(pool: int, k: int, n: int) -> int:
    """Candidates taken: the pool, at least min(k, n), at most n."""
    if k <= 0 or pool <= 0:
        raise ValueError("k and pool must be positive")
    return min(max(pool, min(k, n)), n)


def unit(vector: list[float], dimensions: int | None = None) -> list[float]:
    """A query vector of length one; raises where it is of another size, not finite or zero."""
    v = np.asarray(vector, np.float64)
    if v.ndim != 1 or not len(v) or (dimensions is not None and len(v) != dimensions):
        raise ValueError(f"a query vector must have {dimensions} entries")
    size = float(np.linalg.norm(v))
    if not np.isfinite(v).all() or not size > 0:
        raise ValueError("a query vector must be finite and not zero")
    return (v / size).tolist()


def score(embedding: Column, query: list[float]) -> Column:
    # Parsed from text the vector is one literal of the plan, not one for each dimension.
    return F.round(dot(embedding, F.from_json(F.lit(json.dumps([float(x) for x in query])), "array<double>")), SCORE_DECIMALS)


def top_candidates(corpus: DataFrame, query: list[float], n: int, key: str) -> DataFrame:
    """The ``n`` rows with the highest scores, ties by ``key``: every task keeps n rows, and only these meet."""
    return corpus.withColumn("score", score(F.col("embedding"), query)).orderBy(F.desc("score"), F.asc(key)).limit(n)


class Best:
    """The ``n`` best (score, key) of each of several queries over all rows seen so far, ties by the smaller key."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.scores = np.full((queries, n), -np.inf)
        self.keys: np.ndarray | None = None

    def see(self, scores: np.ndarray, keys: np.ndarray, first: int = 0) -> None:
        """``scores`` (queries from ``first`` on, rows), not yet rounded, of rows whose ``keys`` rise."""
        if self.keys is None:
            self.keys = np.zeros(self.scores.shape, keys.dtype)
        elif keys.dtype.itemsize > self.keys.dtype.itemsize:  # texts grow longer
            self.keys = self.keys.astype(keys.dtype)
        # What rounds up to the last score held is less than a unit below it; only what comes so near is rounded.
        hit = scores >= (self.scores[first : first + len(scores), -1] - 10.0**-SCORE_DECIMALS)[:, None]
        counts = np.count_nonzero(hit, axis=1)
        many = np.flatnonzero(counts > self.n)
        if len(many):
            hit[many] = _highest(np.where(hit[many], _rounded(scores[many]), -np.inf), self.n) & hit[many]
            counts[many] = np.count_nonzero(hit[many], axis=1)
        some = np.flatnonzero(counts)
        if not len(some):
            return
        rows, columns = np.nonzero(hit[some])
        held = counts[some]
        place = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held)
        new, new_keys = np.full((len(some), int(held.max())), -np.inf), np.zeros((len(some), int(held.max())), keys.dtype)
        new[rows, place], new_keys[rows, place] = _rounded(scores[some[rows], columns]), keys[columns]
        both = np.concatenate([self.scores[first + some], new], axis=1)
        both_keys = np.concatenate([self.keys[first + some], new_keys], axis=1)
        order = np.lexsort((both_keys, -both), axis=-1)[:, : self.n]
        self.scores[first + some] = np.take_along_axis(both, order, axis=1)
        self.keys[first + some] = np.take_along_axis(both_keys, order, axis=1)

    def batches(self, ids: pa.Array, key_type: pa.DataType, names: list[str], together: int = 4096) -> Iterator[pa.RecordBatch]:
        """query, key, score and place (from 1) of what is held, or the first of these that ``names`` has names for."""
        for at in range(0, len(self.scores) if self.keys is not None else 0, together):
            held = np.isfinite(self.scores[at : at + together])
            query, place = np.nonzero(held)
            if len(query):
                keys, order = self.keys[at + query, place], np.cumsum(held, axis=1, dtype=np.int32)[query, place]
                arrays = [ids.take(pa.array(at + query)), pa.array(keys.tolist(), key_type), pa.array(self.scores[at + query, place]), pa.array(order)]
                yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_DECIMALS) + 0.0


def _highest(scores: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` highest of each row are, ties by the smaller column."""
    edge = np.partition(scores, -n, axis=1)[:, -n][:, None]
    above, level = scores > edge, scores == edge
    return above | (level & (np.cumsum(level, axis=1) <= n - np.count_nonzero(above, axis=1)[:, None]))


def _plain_keys(keys: pa.Array) -> np.ndarray:
    """Whole numbers as they are, texts as an array that sorts by code points."""
    return np.array(keys.to_pylist(), str) if pa.types.is_string(keys.type) or pa.types.is_large_string(keys.type) else keys.to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _units(vectors: np.ndarray) -> np.ndarray:
    return np.array([unit(v) for v in vectors]) if len(vectors) else vectors


def _scan(best: Best, queries: np.ndarray, keys: pa.Array, vectors: pa.Array) -> None:
    """Rows against all queries, in tiles of bounded bytes."""
    step = max(1, ROW_BYTES // (8 * queries.shape[1]))
    for first in range(0, len(keys), step):
        block, names = _matrix(vectors.slice(first, step)), _plain_keys(keys.slice(first, step))
        order = np.argsort(names, kind="stable")
        block, names = block[order], names[order]
        together = max(1, SCORE_BYTES // (8 * len(names)))
        for begin in range(0, len(queries), together):
            best.see(queries[begin : begin + together] @ block.T, names, begin)


def _ranked(found: DataFrame, n: int, key: str, query_key: str) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _size(queries: DataFrame) -> Row:
    """Number and dimensions of the queries."""
    return queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()


def batch_candidates(corpus: DataFrame, queries: DataFrame, n: int, key: str, query_key: str = "query_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, key, score and place (from 1) of the ``n`` best rows for each query (ids differ).

    A batch of at most ``query_bytes`` goes to all tasks, which read the corpus where it lies; a larger one, or one whose
    best rows of all tasks would pass FOUND_BYTES, is dealt out (``blocked_candidates``). A task keeps the n best
    rows of each query over all its rows, so that at most (tasks x queries x n) rows are shuffled.
    """
    size, tasks = _size(queries), corpus.sparkSession.sparkContext.defaultParallelism
    if size.n * size.d * 8 > query_bytes or tasks * size.n * n * FOUND_ROW > FOUND_BYTES:
        return blocked_candidates(corpus, queries, n, key, query_key, query_bytes)
    rows = queries.select(query_key, "embedding").collect()
    types = {f.name: f.dataType.simpleString() for f in corpus.schema}
    query_type = queries.schema[query_key].dataType
    sent = corpus.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in rows], to_arrow_type(query_type)), _units(np.array([r[1] for r in rows], np.float64))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        best, kind = Best(len(ids), n), None
        for batch in batches:
            kind = batch.column(key).type
            if batch.num_rows and len(ids):
                _scan(best, vectors, batch.column(key), batch.column("embedding"))
        yield from best.batches(ids, kind, [query_key, key, "score"])

    found = corpus.select(key, "embedding").coalesce(tasks).mapInArrow(run, f"{query_key} {query_type.simpleString()}, {key} {types[key]}, score double")
    out = _ranked(found, n, key, query_key)
    out._sent = sent
    return out


def release(candidates: DataFrame) -> None:
    """Frees the query vectors that all tasks have, when the candidates have been written."""
    if (sent := getattr(candidates, "_sent", None)) is not None:
        sent.destroy()


def grid(queries: int, rows: int, n: int, vector: int, cells: int, least: int = 1) -> tuple[int, int]:
    """(groups, stripes) with ``cells`` cells or more, and ``least`` groups or more, that move the fewest bytes: the rows go out
    once for each group; the queries once for each stripe, with the n best rows of each if there is more than one."""

    def groups(stripes: int) -> int:
        return max(least, -(-cells // stripes))

    def moved(stripes: int) -> int:
        return rows * groups(stripes) * vector + queries * stripes * (vector + (n * FOUND_ROW if stripes > 1 else 0))

    stripes = min(range(1, cells + 1), key=moved)
    return groups(stripes), stripes


def blocked_candidates(corpus: DataFrame, queries: DataFrame, n: int, key: str, query_key: str = "query_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The same for any number of queries: nothing is collected or broadcast.

    Queries are dealt out to groups that fit in ``query_bytes``, and the corpus to stripes; each pair of a
    group and a stripe is a cell, and a task. A cell reads its queries first and then its stripe, row by row,
    with the best rows of its queries so far. There are as many cells as the session has cores, and more only where a cell
    would have more than CELL_PAIRS pairs or a group would not fit, so that what moves does not grow with the number of
    shuffle partitions; ``grid`` says of what shape. In a single stripe a cell's best rows are final. Rows are
    dealt out by the hash of their key, so a task that is repeated deals alike, and equal vectors do not meet in one cell.
    """
    size, total = _size(queries), corpus.count()
    # Dealt out by hash, groups differ a little in size.
    least = max(1, -(-size.n * size.d * 8 * 10 // (query_bytes * 9)))
    cells = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size.n * total // CELL_PAIRS))
    types = {f.name: f.dataType.simpleString() for f in corpus.schema}
    query_type, query_vector = (queries.schema[c].dataType.simpleString() for c in (query_key, "embedding"))
    vector = "array<float>" if types["embedding"] == query_vector == "array<float>" else "array<double>"
    groups, stripes = grid(size.n, total, n, 8 + size.d * (4 if vector == "array<float>" else 8), cells, least)
    one = queries.select(F.pmod(F.xxhash64(query_key), F.lit(groups)).alias("g"), F.col(query_key).alias("q"), F.lit(None).cast(types[key]).alias("k"), F.col("embedding").cast(vector).alias("v"))
    one = one.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    two = corpus.select(F.pmod(F.xxhash64(key), F.lit(stripes)).alias("s"), F.lit(None).cast(query_type).alias("q"), F.col(key).alias("k"), F.col("embedding").cast(vector).alias("v"))
    two = two.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = (F.col("g") * stripes + F.col("s")).cast("int").alias("cell")
    rows = one.select(cell, F.lit(0).alias("side"), "q", "k", "v").unionByName(two.select(cell, F.lit(1).alias("side"), "q", "k", "v"))
    dealt = rows.repartitionById(groups * stripes, "cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = [query_key, key, "score", "place"][: 4 if stripes == 1 else 3], None
        cell, ids, held, vectors, best = None, [], [], None, None
        for whole in batches:
            kind = whole.column("k").type
            at = whole.column("cell").to_numpy() * 2 + whole.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if first == stop:
                    continue
                part = whole.slice(first, stop - first)
                if at[first] // 2 != cell:
                    if best is not None:
                        yield from best.batches(pa.concat_arrays(ids), kind, names)
                    cell, ids, held, vectors, best = at[first] // 2, [], [], None, None
                if at[first] % 2 == 0:
                    ids.append(part.column("q"))
                    held.append(_units(_matrix(part.column("v"))))
                elif held:
                    if best is None:
                        vectors = np.concatenate(held)
                        best = Best(len(vectors), n)
                    _scan(best, vectors, part.column("k"), part.column("v"))
        if best is not None:
            yield from best.batches(pa.concat_arrays(ids), kind, names)

    ddl = f"{query_key} {query_type}, {key} {types[key]}, score double"
    return dealt.mapInArrow(run, f"{ddl}, place int") if stripes == 1 else _ranked(dealt.mapInArrow(run, ddl), n, key, query_key)
