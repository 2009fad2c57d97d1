"""Substring dedup by hashing content-defined units of text.

Whole lines or paragraphs miss a passage that begins inside a line, so a text is cut into
units that depend on nothing but the words around them: of all runs of ``unit`` words, those
whose hash is the smallest among ``spread`` neighbours (winnowing). A repeated passage gives
the same units wherever it stands: of a repeat of L words at least L - 2 * (spread - 1) are
covered. Units are grouped by digest over all documents, the earliest document keeps them,
and stretches of at least ``min_words`` covered words are removed from the others. Spans are
reported as offsets into the original text.

Two options take the whole repeat. ``widen`` groups, in a second round, every unit that
stands next to a repeated one, chosen or not, so a repeat goes up to its true ends. With
``block_words`` whole lines, paragraphs and texts are units too, and go at any length from there.

Only (document, digest) pairs are grouped, written once, with a partial aggregate, so a passage
that a third of all documents share costs a row per task. Texts move once, with ``widen`` those
that share a unit twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.session import discard, stash


@dataclass(frozen=True)
class SubstringDedup:
    unit: int = 12  # words hashed together
    spread: int = 12  # neighbouring units of which one is chosen
    #: Covered words in a row that make a repeat. With the defaults a repeat of 50 words is
    #: always covered over 28 or more, and nothing shorter than 28 words is ever removed.
    min_words: int = 28
    #: Whether all units beside a repeated one are grouped as well. Every repeat of
    #: ``min_words`` then goes whole (unit + spread - 1 words always hold a chosen unit).
    widen: bool = False
    #: Least words of a line, paragraph or text that goes as a whole; 0: none does.
    block_words: int = 0


#: What the query runs: whole repeats, and whole lines of a unit's length.
WHOLE = SubstringDedup(widen=True, block_words=12)


def units(data: bytes, p: SubstringDedup) -> tuple[np.ndarray, np.ndarray, int]:
    """(first words of the chosen units, their digests as int64, number of words). Letters A-Z count as a-z."""
    g, n = _all_units(data, p)
    at = _chosen(g, p)
    return at, g[at].view(np.int64), n


def _all_units(data: bytes, p: SubstringDedup) -> tuple[np.ndarray, int]:
    hashes = W.word_hashes(data.lower())
    return W.grams(hashes, p.unit), len(hashes)


def _chosen(g: np.ndarray, p: SubstringDedup) -> np.ndarray:
    if len(g) < p.spread:
        at = np.array([int(g.argmin())]) if len(g) else np.zeros(0, np.int64)
    else:
        chosen = [np.arange(a, b) + np.lib.stride_tricks.sliding_window_view(g[a : b + p.spread - 1], p.spread).argmin(axis=1) for a, b in _runs(len(g) - p.spread + 1)]
        at = np.unique(np.concatenate(chosen))
    return at


def blocks(data: bytes, p: SubstringDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, end words, digests) of the lines, paragraphs and the text that have
    ``block_words`` words, each stretch once, the whole text last. However the words are spaced, they
    give the same digest."""
    found: dict[tuple[int, int], int] = {}

    def add(begin: int, words: list[bytes]) -> None:
        if len(words) >= p.block_words:
            found.setdefault((begin, begin + len(words)), xxhash.xxh3_64_intdigest(b" ".join(words)))

    at, text, paragraph = 0, [], []
    for line in data.lower().split(b"\n") if p.block_words else ():
        words = line.split()
        add(at, words)
        at += len(words)
        if words:
            paragraph += words
        elif paragraph:
            add(at - len(paragraph), paragraph)
            text += paragraph
            paragraph = []
    if p.block_words:
        add(at - len(paragraph), paragraph)
        add(0, text + paragraph)
    bounds = np.array(sorted(found, key=lambda b: b[1] - b[0]), np.int64).reshape(-1, 2)
    digests = np.array([found[a, b] for a, b in bounds.tolist()], np.uint64).view(np.int64)
    return bounds[:, 0], bounds[:, 1], digests


def beside(data: bytes, later: np.ndarray, own: np.ndarray, p: SubstringDedup) -> np.ndarray:
    """Digests for the second round: all units that begin within ``spread`` - 1 words of a chosen
    one that other documents have (earlier ones ``later``, none but later ones ``own``), and the shared blocks. Of a text
    that an earlier one has whole, only that."""
    g, n = _all_units(data, p)
    first, end, digests = blocks(data, p)
    if len(digests) and end[-1] - first[-1] == n and (digests[-1] == later).any():
        return digests[-1:]
    shared = np.concatenate([later, own])
    at = _chosen(g, p)
    hit = at[np.isin(g[at].view(np.int64), shared)]
    near = W.covered(np.maximum(hit - p.spread + 1, 0), 2 * p.spread - 1, len(g) + 2 * p.spread)[: len(g)]
    return W.distinct(np.concatenate([g.view(np.int64)[near], digests[np.isin(digests, shared)]]))


def _runs(n: int, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def spans(data: bytes, repeated: np.ndarray, p: SubstringDedup) -> list[tuple[int, int, int, int]]:
    """(first byte, end byte, first word, end word) of what goes: stretches covered by units
    whose digest is in ``repeated``, or that the text itself has had before; and such blocks."""
    if p.widen:
        g, n = _all_units(data, p)
        at, digests = np.arange(len(g)), g.view(np.int64)
    else:
        at, digests, n = units(data, p)
    first, stop, whole = blocks(data, p)
    if not len(at) and not len(whole):
        return []
    hit = at[_again(digests) | np.isin(digests, repeated)]
    # Blocks of one digest have as many words: the earliest begins first.
    order = np.argsort(first, kind="stable")
    gone = order[_again(whole[order]) | np.isin(whole[order], repeated)]
    if not len(hit) and not len(gone):
        return []
    begin, end = _stretches(W.covered(hit, p.unit, n))
    long = end - begin >= p.min_words
    if len(gone):
        mask = np.zeros(n, bool)
        for a, b in [*zip(begin[long], end[long], strict=True), *zip(first[gone], stop[gone], strict=True)]:
            mask[a:b] = True
        begin, end = _stretches(mask)
        long = np.ones(len(begin), bool)
    if not long.any():
        return []
    starts, ends = W.word_bounds(np.frombuffer(data, np.uint8))
    return [(int(starts[a]), int(ends[b - 1]), int(a), int(b)) for a, b in zip(begin[long], end[long], strict=True)]


def _again(digests: np.ndarray) -> np.ndarray:
    """Mask of the digests that stand further left as well."""
    again = np.ones(len(digests), bool)
    again[np.unique(digests, return_index=True)[1]] = False
    return again


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Stands for a null id, the earliest of all.
NULL_ID = -(1 << 63)
SPAN_DDL = "array<struct<start:bigint,stop:bigint,first_word:bigint,end_word:bigint>>"
_SPAN = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "stop", "first_word", "end_word")]))


def _digests(docs: DataFrame, p: SubstringDedup, key: str, text: str) -> DataFrame:
    """id, digest: a row for each digest of a document."""
    body = F.col(f"`{text}`")
    inner = docs.filter(body.isNotNull()).select(_id(key).alias("id"), body.cast("binary").alias("data"))
    return _pairs(inner, lambda data: np.unique(np.concatenate([units(data, p)[1], blocks(data, p)[2]])))


def _beside(docs: DataFrame, hits: DataFrame, p: SubstringDedup, key: str, text: str) -> DataFrame:
    """id, digest: a row for each digest of ``beside``, of the documents in ``hits``."""
    body = F.col(f"`{text}`")
    inner = docs.filter(body.isNotNull()).select(_id(key).alias("id"), body.cast("binary").alias("data")).join(hits, "id")
    return _pairs(inner, lambda data, later, own: beside(data, later, own, p), "later", "own")


def _pairs(rows: DataFrame, found_in: Callable[..., np.ndarray], *lists: str) -> DataFrame:
    """id, digest from rows with id, data and columns of digest lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, held = [], [], 0
            rest = [[np.array(x.values, np.int64) for x in batch.column(c)] for c in lists]
            for name, data, *more in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), *rest, strict=True):
                d = found_in(data, *more)
                ids.append(np.full(len(d), name, np.int64))
                found.append(d)
                held += len(d)
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["id", "digest"])
                    ids, found, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["id", "digest"])

    return rows.mapInArrow(run, "id bigint, digest bigint")


def _id(key: str) -> F.Column:
    return F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NULL_ID))


def _shared(pairs: DataFrame) -> DataFrame:
    """digest, keeper (its earliest document) and pairs of the digests that several documents have."""
    firsts = pairs.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n"))
    return stash(firsts.filter("keeper < last").drop("last"), "substring-firsts")


#: A digest with one in so many pairs is a hot one; there are no more such digests than this.
HOT_ONE_IN = 2000


def _met(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """id, digest, keeper of the pairs whose digest is in ``first``. Hot digests, at most HOT_ONE_IN, go to all tasks, so that the
    pairs of a passage that many documents share stay where they lie; the others, none of which is large, are joined by a shuffle."""
    hot = first.filter(F.col("n") * HOT_ONE_IN >= pairs.count())
    names = first.select("digest", "keeper")
    if hot.isEmpty():
        return pairs.join(names, "digest")
    hot = F.broadcast(hot.select("digest", "keeper"))
    rest = pairs.join(hot.select("digest"), "digest", "left_anti").join(names, "digest")
    return pairs.join(hot, "digest").unionByName(rest)


def repeated_units(docs: DataFrame, p: SubstringDedup = SubstringDedup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, digests (array): for each document, the units that an earlier document has."""
    pairs = stash(_digests(docs, p, key, text), "substring-pairs")
    if p.widen:
        chosen, first = pairs, _shared(pairs)
        met = _met(pairs, first)
        kept = F.col("id") == F.col("keeper")
        hits = met.groupBy("id").agg(F.collect_set(F.when(~kept, F.col("digest"))).alias("later"), F.collect_set(F.when(kept, F.col("digest"))).alias("own"))
        pairs = stash(_beside(docs, hits, p, key, text), "substring-beside")
        discard(chosen, first)
    later = _met(pairs, _shared(pairs)).filter("id > keeper").select("id", "digest")
    return later.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def dedup_substrings(docs: DataFrame, p: SubstringDedup = SubstringDedup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text in place, and the columns ``removed`` (spans of the original
    text in code points, with word numbers) and ``removed_words``.

    The rank of a document is its id, an integer, null first; rows that share an id are one
    document and keep what none with a smaller id has. Within a text the first occurrence
    stays. A removed span takes the space before it along, so words never run together. A
    null text stays null and has nothing removed. Texts shorter than a unit (and, if there are
    any, than a block) are left alone.
    Other columns pass through, whatever their names, unless called ``removed`` or
    ``removed_words``, which are replaced. An empty table gives an empty one.
    """
    carried = [c for c in docs.columns if c not in ("removed", "removed_words")]
    hits = repeated_units(docs, p, key, text).withColumnRenamed("id", "to_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), _id(key).alias("id"))
    joined = rows.join(hits, F.col("id") == F.col("to_id"), "left")
    joined = joined.select("row", F.col(f"row.`{text}`").cast("binary").alias("data"), "digests")
    row_type = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, counts = [], [], []
            for data, digests in zip(batch.column("data"), batch.column("digests"), strict=True):
                data = data.as_py()
                gone = [] if data is None else spans(data, np.array(digests.values if digests.is_valid else [], np.int64), p)
                texts.append(None if data is None else cleaned(data, gone) if gone else data)
                found.append(_in_points(data, gone))
                counts.append(sum(d - c for _, _, c, d in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.binary()), pa.array(found, _SPAN), pa.array(counts, pa.int64())], ["row", "clean", "removed", "removed_words"]
            )

    out = joined.mapInArrow(run, f"row {row_type}, clean binary, removed {SPAN_DDL}, removed_words bigint")
    return out.select(*[F.col("clean").cast("string").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in carried], "removed", "removed_words")


def cleaned(data: bytes, gone: list[tuple[int, int, int, int]]) -> bytes:
    """The text without the spans, each with the space before it."""
    parts, at = [], 0
    for start, stop, _, _ in gone:
        while start > at and W.SPACE[data[start - 1]]:
            start -= 1
        parts.append(data[at:start])
        at = stop
    parts.append(data[at:])
    return b"".join(parts)


def _in_points(data: bytes | None, gone: list[tuple[int, int, int, int]]) -> list[dict]:
    """Byte offsets as code points."""
    if not gone:
        return []
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=points[1:])
    return [{"start": int(points[a]), "stop": int(points[b]), "first_word": c, "end_word": d} for a, b, c, d in gone]


def report(docs: DataFrame, p: SubstringDedup = WHOLE) -> DataFrame:
    """doc_id, cleaned text, removed spans and removed words of every document."""
    return dedup_substrings(docs.select("doc_id", "text"), p)
