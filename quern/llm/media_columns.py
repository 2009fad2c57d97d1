"""Media columns: texts stored as WAV samples, with spectral-peak fingerprints.

A payload is stored as an 8-bit mono WAV file held in a binary column, read back with the
``wave`` module, and described by a short-time Fourier transform: the strongest local peaks
of every frame are paired with the peaks that follow, and every pair becomes one long whose
upper half is the time of its first peak and whose lower half codes (f1, f2, dt).

Narrow passes without a shuffle. The query writes the files to the shared folder, computes peaks and fingerprints
from the files that it reads there, writes these too, and takes the features from the arrays that it reads
back. A payload is transformed block by block, so memory is a few MB plus the payload and its
fingerprints, whatever its length.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import binary_column
from quern.session import discard, stash


@dataclass(frozen=True)
class Spectrum:
    """Parameters of storage and fingerprints."""

    unit: int = 64  # payloads are padded to a positive multiple of this
    rate: int = 8000
    frame: int = 256
    hop: int = 128
    peaks: int = 3  # strongest local maxima kept per frame
    fan: int = 5  # following peaks that a peak may be paired with
    reach: int = 16  # frames that a pair may span
    block: int = 4096  # frames transformed at once
    batch_bytes: int = 8 << 20  # of stored files and fingerprints that leave a worker together


def padded(data: bytes, unit: int) -> bytes:
    """``data`` followed by zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or (unit if not data else 0))


def to_wav(payload: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono file")
        return r.readframes(r.getnframes())


def peaks_of(samples: np.ndarray, p: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Times and frequencies of the peaks, in order of time, then frequency.

    A peak is larger than its neighbours in frequency and not smaller than the same bin one
    frame before and after; of each frame's peaks the strongest ``p.peaks`` stay.
    """
    n = max(1, -(-(len(samples) - p.frame) // p.hop) + 1)
    full = np.zeros((n - 1) * p.hop + p.frame, np.uint8)
    full[:] = 128
    full[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(full, p.frame)[:: p.hop]
    window = np.hanning(p.frame).astype(np.float32)
    times, freqs = [], []
    for first in range(0, n, p.block):
        lo, hi = max(0, first - 1), min(n, first + p.block + 1)  # with a frame of context on each side
        wave_block = (frames[lo:hi].astype(np.float32) - 128) * window
        bins = np.fft.rfft(wave_block, axis=1)
        power = (bins.real**2 + bins.imag**2).astype(np.float32)
        inner = power[:, 1:-1]
        top = (inner > power[:, :-2]) & (inner > power[:, 2:]) & (inner > 1e-3)
        top[1:] &= inner[1:] >= inner[:-1]
        top[:-1] &= inner[:-1] >= inner[1:]
        cut = slice(first - lo, first - lo + min(p.block, n - first))
        score = np.where(top[cut], inner[cut], 0)
        best = np.argpartition(score, -p.peaks, axis=1)[:, -p.peaks :]
        t = np.repeat(np.arange(first, first + len(score)), p.peaks)
        f = best.ravel()
        real = score[t - first, f] > 0
        t, f = t[real], f[real] + 1
        order = np.lexsort((f, t))
        times.append(t[order])
        freqs.append(f[order])
    return np.concatenate(times).astype(np.int64), np.concatenate(freqs).astype(np.int64)


def fingerprints(times: np.ndarray, freqs: np.ndarray, p: Spectrum) -> np.ndarray:
    """Time-coded pair fingerprints: t1 << 32 | f1 << 20 | f2 << 8 | dt, sorted."""
    found = []
    for k in range(1, p.fan + 1):
        dt = times[k:] - times[:-k]
        ok = (dt > 0) & (dt <= p.reach)
        found.append((times[:-k][ok] << 32) | (freqs[:-k][ok] << 20) | (freqs[k:][ok] << 8) | dt[ok])
    return np.sort(np.concatenate(found))


def described(stored: bytes, p: Spectrum) -> tuple[dict, int, np.ndarray]:
    """(digests of a stored file and of what it gives back, number of its peaks, its fingerprints)."""
    back = from_wav(stored)
    times, freqs = peaks_of(np.frombuffer(back, np.uint8), p)
    digests = {
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-p.unit :]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
    }
    return digests, len(times), fingerprints(times, freqs, p)


def feature(n_peaks: int, marks: np.ndarray) -> str:
    """Peaks, pairs, and a digest of the pairs."""
    return f"{n_peaks}:{len(marks)}:{xxhash.xxh3_64_hexdigest(marks.tobytes())}"


DIGESTS = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
)
_TYPES = {"bigint": pa.int64(), "string": pa.string()}


def _batches(keys: pa.Array, rows: Iterable[tuple[list, int]], fields: list[tuple[str, pa.DataType]], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of key and ``fields`` from rows of (values, bytes), of about ``most`` bytes each."""
    held, size, first = [], 0, 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([keys.slice(first, len(held)), *[pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]], ["key", *[n for n, _ in fields]])

    for values, weight in rows:
        held.append(values)
        size += weight
        if size > most:
            yield out()
            first, held, size = first + len(held), [], 0
    if held:
        yield out()


def store_media(docs: DataFrame, p: Spectrum = Spectrum(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (under that name), n_bytes and media: the whole text of every row, in UTF-8 and padded, as a WAV file.

    A null text is stored as an empty one (one unit of zero bytes). Repeated rows give repeated,
    equal results; an empty table gives an empty one; other columns are not read.
    """
    fields = [("n_bytes", pa.int64()), ("media", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = ((len(d), to_wav(padded(d, p.unit), p.rate)) for d in binary_column(batch, "data"))
            yield from _batches(batch.column("key"), (([n, f], len(f)) for n, f in files), fields, p.batch_bytes)

    inner = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    return inner.mapInArrow(run, f"key {inner.schema['key'].dataType.simpleString()}, n_bytes bigint, media binary")


MARKED = [(f.split()[0], _TYPES[f.split()[1]]) for f in DIGESTS.split(", ") if not f.startswith("feature")]


def mark_media(stored: DataFrame, p: Spectrum = Spectrum()) -> DataFrame:
    """The digests, n_peaks and marks (the fingerprints) of every stored file, from the file."""
    fields = [*MARKED, ("n_peaks", pa.int64()), ("marks", pa.list_(pa.int64()))]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[list, int]]:
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            digests, n_peaks, marks = described(media.as_py(), p)
            yield [n, *[digests[name] for name, _ in MARKED[1:]], n_peaks, marks], marks.nbytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(batch.column("key"), rows(batch), fields, p.batch_bytes)

    ddl = DIGESTS.replace(", feature string", "")
    return stored.mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, {ddl}, n_peaks bigint, marks array<bigint>")


def featured(marked: DataFrame, key: str) -> DataFrame:
    """``key``, the digests, and the feature of the marks as they stand in their column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature(n, np.array(x.values, np.int64)) for n, x in zip(batch.column("n_peaks").to_pylist(), batch.column("marks"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[batch.column(n) for n, _ in MARKED], pa.array(found, pa.string())], ["key", *[n for n, _ in MARKED], "feature"])

    return marked.mapInArrow(run, f"key {marked.schema['key'].dataType.simpleString()}, {DIGESTS}").withColumnRenamed("key", key)


def media_report(docs: DataFrame, p: Spectrum = Spectrum(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the digests of every row's text, of the media and marks columns as they are stored."""
    stored = stash(store_media(docs, p, key, text), "media-files", compression="zstd")
    marked = stash(mark_media(stored, p), "media-marks", compression="zstd")
    discard(stored)
    return featured(marked, key)
