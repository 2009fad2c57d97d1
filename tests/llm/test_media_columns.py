import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import media_columns as M

TEXTS = [None, "", "a", "x" * 63, "y" * 64, "z" * 65, "é" * 1000, "words and more words " * 20000, "same", "same"]


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").selectExpr("*", "1 as key", "2 as media", "3 as n_bytes")
    stored = M.store_media(df)
    assert stored.columns == ["key", "n_bytes", "media"]
    files = {r.key: bytes(r.media) for r in stored.collect()}
    marked = {r.key: r for r in M.mark_media(stored).collect()}
    rows = {r.doc_id: r for r in M.media_report(df).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        full = data + b"\0" * (64 if not data else -len(data) % 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-64:])
        assert M.from_wav(files[i]) == full and r.media_bytes == len(files[i])
        assert r.media_sha256 == hashlib.sha256(files[i]).hexdigest()
        times, freqs = M.peaks_of(np.frombuffer(full, np.uint8), M.Spectrum())
        marks = M.fingerprints(times, freqs, M.Spectrum())
        assert marked[i].marks == marks.tolist() == sorted(marks.tolist()) and r.feature == M.feature(len(times), marks)
    assert rows[8].feature == rows[9].feature
    assert M.media_report(df.limit(0)).count() == 0
    assert {r.doc_id: r for r in M.media_report(df, M.Spectrum(batch_bytes=100)).collect()} == rows


def test_tone_gives_its_bin_and_blocks_agree():
    # A burst of one tone peaks in its own bin, in the frame around its middle.
    t = np.arange(20000)
    burst = 128 + 100 * np.exp(-(((t - 9000) / 500) ** 2)) * np.sin(2 * np.pi * 32 * t / 256)
    times, freqs = M.peaks_of(np.round(burst).astype(np.uint8), M.Spectrum(peaks=1))
    near = np.abs(times * 128 + 128 - 9000) <= 128
    assert 32 in freqs[near].tolist()
    rng = np.random.default_rng(1).integers(0, 256, 50000).astype(np.uint8)
    one, many = M.peaks_of(rng, M.Spectrum()), M.peaks_of(rng, M.Spectrum(block=7))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))


def plain_peaks(samples, p):
    """Peaks by a transform written out as sums, frame by frame."""
    n = max(1, -(-(len(samples) - p.frame) // p.hop) + 1)
    full = np.concatenate([samples.astype(np.float64), np.full((n - 1) * p.hop + p.frame - len(samples), 128.0)]) - 128
    k, t = np.arange(p.frame // 2 + 1)[:, None], np.arange(p.frame)[None, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.frame) / (p.frame - 1))
    turn = np.exp(-2j * np.pi * k * t / p.frame)
    power = np.array([np.abs(turn @ (full[i * p.hop : i * p.hop + p.frame] * window)) ** 2 for i in range(n)])
    found = []
    for i in range(n):
        tops = []
        for f in range(1, p.frame // 2):
            here = power[i, f]
            beside = [power[i, f - 1], power[i, f + 1]]
            before_after = [power[j, f] for j in (i - 1, i + 1) if 0 <= j < n]
            if here > 1e-3 and all(here > x for x in beside) and all(here >= x for x in before_after):
                tops.append((here, f))
        found += [(i, f) for f in sorted(f for _, f in sorted(tops, reverse=True)[: p.peaks])]
    return found


def test_peaks_match_a_plain_transform():
    rng = np.random.default_rng(6)
    text = np.frombuffer(b"".join(bytes([97 + int(x)]) * int(y) for x, y in zip(rng.integers(0, 26, 900), rng.integers(1, 6, 900), strict=True)), np.uint8)
    for samples in (rng.integers(0, 256, 4000).astype(np.uint8), text, np.zeros(64, np.uint8)):
        p = M.Spectrum()
        times, freqs = M.peaks_of(samples, p)
        got, want = list(zip(times.tolist(), freqs.tolist(), strict=True)), plain_peaks(samples, p)
        # Single and double precision may differ where two bins are all but equal.
        assert len(set(got) ^ set(want)) <= 0.01 * len(want)


def test_null_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, None), (3, "a")], "doc_id bigint, text string")
    rows = M.media_report(df).collect()
    assert sorted(r.n_bytes for r in rows) == [0, 1, 1, 1] and len({r.feature for r in rows if r.n_bytes}) == 1


def test_pairs_match_brute_force():
    rng = np.random.default_rng(2)
    p = M.Spectrum()
    times = np.sort(rng.integers(0, 60, 90))
    freqs = rng.integers(1, 128, 90)
    want = []
    for i in range(90):
        for j in range(i + 1, min(90, i + 1 + p.fan)):
            dt = int(times[j] - times[i])
            if 0 < dt <= p.reach:
                want.append(int(times[i]) << 32 | int(freqs[i]) << 20 | int(freqs[j]) << 8 | dt)
    assert M.fingerprints(times, freqs, p).tolist() == sorted(want)


def test_query_reads_stored_columns(spark, tmp_path, monkeypatch):
    from quern.llm import media_columns, registry
    from quern.session import stash

    written = []

    docs = spark.createDataFrame([(1, "some text " * 90), (2, None), (None, "é"), (1, "some text " * 90)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # Files are changed between the first pass and the second, and arrays between the second and the third.
    changed = bytes(range(256)) * 10
    put = {"media-files": ("media", M.to_wav(changed, 8000)), "media-marks": ("marks", [5, 6])}

    def tampered(df, label, **options):
        written.append(label)
        name, value = put[label]
        return stash(df.withColumn(name, F.lit(bytearray(value)) if isinstance(value, bytes) else F.array(*map(F.lit, value)).cast("array<bigint>")), label, **options)

    monkeypatch.setattr(media_columns, "stash", tampered)
    got = registry.op1_media_columns(spark, str(tmp_path)).collect()
    assert written == ["media-files", "media-marks"] and len(got) == 4
    assert {r.payload_sha256 for r in got} == {hashlib.sha256(changed).hexdigest()}
    assert {r.feature.split(":", 1)[1] for r in got} == {M.feature(0, np.array([5, 6])).split(":", 1)[1]}
