"""Word segmentation and hashing over UTF-8 bytes, shared by the numpy operators.

A word is a maximal run of bytes outside space and 0x09-0x0D. ``bytes.split`` cuts at
exactly that set (``str.split`` would also cut at Unicode spaces).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: SQL form of the word pattern, for Spark and DuckDB alike.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: A text is hashed in pieces of about this many bytes, so that the list of its words stays small.
PIECE = 1 << 20


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` cut only at spaces, in pieces of about ``size`` bytes (longer where a word is)."""
    if len(data) <= size:
        yield data
        return
    start, n = 0, len(data)
    while start < n:
        stop = min(n, start + size)
        while stop < n and not SPACE[data[stop]]:
            window = np.frombuffer(data, np.uint8, count=min(size, n - stop), offset=stop)
            at = np.flatnonzero(SPACE[window])
            stop = stop + int(at[0]) if len(at) else stop + len(window)
        yield data[start:stop]
        start = stop


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    parts = []
    for piece in pieces(data):
        words = piece.split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in a uint8 array."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(SPACE[buf], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling hash over words.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of word hashes, in order; empty with fewer than n words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    rolled = hashes[:count].copy()
    for k in range(1, n):
        rolled *= ROLL
        rolled += hashes[k : k + count]
    return mix64(rolled)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n words that lie in a window of ``width`` beginning at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated(values: np.ndarray) -> np.ndarray:
    """Positions whose value occurs at least twice."""
    ordered = np.sort(values)
    if not (ordered[1:] == ordered[:-1]).any():
        return np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    hit = np.zeros(len(values), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.flatnonzero(hit)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values. numpy's own hashes them, which is slower than its sort."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def binary_column(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The column's values as bytes, one at a time; null is empty."""
    for value in batch.column(name):
        yield value.as_py() or b""
