"""Language identification by a small byte convolutional network.

The network: byte embedding, convolutions of several widths, max pooling over a fixed-length
window, softmax. It is trained in numpy on the driver with a bounded sample of labelled texts
(``docs_per_lang`` documents of each language, chosen by hash among all, ``windows_per_doc``
windows of each). Prediction runs over every window of every whole text, in batches, in one
narrow pass; the model is a few KB in the closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stash

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    window: int = 256  # bytes
    dim: int = 6
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12  # per width
    docs_per_lang: int = 300
    windows_per_doc: int = 6
    steps: int = 700
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    predict_batch: int = 512  # windows
    broadcast_langs: int = 10_000  # languages are broadcast with their counts up to this many


def windows_of(data: bytes, size: int) -> np.ndarray:
    """The text as rows of ``size`` bytes, the last padded with zeros; at least one row."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteCNN:
    """Forward and backward passes; parameters are plain arrays."""

    def __init__(self, langs: list[str], p: LangParams):
        rng = np.random.default_rng(p.seed)
        self.langs, self.p = langs, p
        self.emb = rng.normal(0, 0.3, (256, p.dim)).astype(np.float32)
        self.conv = [rng.normal(0, 1 / np.sqrt(w * p.dim), (w * p.dim, p.filters)).astype(np.float32) for w in p.widths]
        self.bias = [np.zeros(p.filters, np.float32) for _ in p.widths]
        self.out = rng.normal(0, 0.1, (len(p.widths) * p.filters, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, *self.bias, self.out, self.out_bias]

    def _columns(self, x: np.ndarray, width: int) -> np.ndarray:
        """(windows * positions, width * dim): the embedded bytes under each position of a filter."""
        rows, size = x.shape[:2]
        dim = self.p.dim
        view = np.lib.stride_tricks.as_strided(x, (rows, size - width + 1, width * dim), (x.strides[0], x.strides[1], x.strides[2]))
        return view.reshape(-1, width * dim)

    def pooled(self, windows: np.ndarray, keep: bool = False):
        x = np.ascontiguousarray(self.emb[windows])
        feats, seen = [], []
        for w, c, b in zip(self.p.widths, self.conv, self.bias, strict=True):
            cols = self._columns(x, w)
            act = (cols @ c).reshape(len(windows), -1, self.p.filters)
            if keep:
                at = act.argmax(axis=1)
                top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0, :]
                seen.append(at)
            else:
                top = act.max(axis=1)
            feats.append(np.maximum(top + b, 0))  # rectified after pooling: the same, and cheaper
        return np.concatenate(feats, axis=1), x, seen

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows)[0] @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        feats, x, seen = self.pooled(windows, keep=True)
        logits = feats @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(labels)), labels] -= 1
        d /= len(labels)
        g_out, g_out_bias = feats.T @ d, d.sum(axis=0)
        d_feats = (d @ self.out.T) * (feats > 0)
        g_emb = np.zeros_like(self.emb)
        g_conv, g_bias = [], []
        dim, k = self.p.dim, self.p.filters
        rows = np.arange(len(windows))[:, None]
        for i, (w, c) in enumerate(zip(self.p.widths, self.conv, strict=True)):
            df = d_feats[:, i * k : (i + 1) * k]
            at = seen[i]
            # Only the position that won the pooling has a gradient.
            under = np.stack([x[rows, at + j] for j in range(w)], axis=2).reshape(len(windows), k, w * dim)
            g_conv.append(np.einsum("nkd,nk->dk", under, df))
            g_bias.append(df.sum(axis=0))
            back = df[:, :, None] * c.T[None]
            for j in range(w):
                np.add.at(g_emb, windows[rows, at + j], back[:, :, j * dim : (j + 1) * dim])
        return [g_emb, *g_conv, *g_bias, g_out, g_out_bias]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], p: LangParams) -> ByteCNN:
    """Adam over batches balanced by language, with windows cut short at random so that short texts are known too."""
    net, rng = ByteCNN(langs, p), np.random.default_rng(p.seed)
    of = [np.flatnonzero(labels == k) for k in range(len(langs))]
    of = [rows for rows in of if len(rows)]
    params = net.params()
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for step in range(1, p.steps + 1):
        pick = np.array([rng.choice(of[i % len(of)]) for i in range(p.batch)])
        x = windows[pick].copy()
        for row in range(len(x)):
            if rng.random() < 0.4:
                x[row, rng.integers(12, p.window) :] = 0
        grads = net.gradients(x, labels[pick])
        rate = p.rate * (1 - step / (p.steps + 1))
        for a, g, m1, v1 in zip(params, grads, m, v, strict=True):
            m1 += 0.1 * (g - m1)
            v1 += 0.001 * (g * g - v1)
            a -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(data: bytes) -> bool:
    if _ASCII_LETTER(data):
        return True
    return not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def predict_text(net: ByteCNN, data: bytes) -> tuple[str, float]:
    """The language with the largest mean probability over all windows, and that mean."""
    total = np.zeros(len(net.langs))
    windows = windows_of(data, net.p.window)
    for at in range(0, len(windows), net.p.predict_batch):
        total += net.probabilities(windows[at : at + net.p.predict_batch]).sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    return net.langs[best], float(min(1.0, total[best] / len(windows)))


def predict_batch(net: ByteCNN, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """Short texts share the network's batches; longer ones have their own."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    size, room = net.p.window, net.p.predict_batch
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        probs = net.probabilities(np.concatenate([w for _, w in held]))
        at = 0
        for i, w in held:
            mean = probs[at : at + len(w)].mean(axis=0, dtype=np.float64)
            at += len(w)
            best = int(mean.argmax())
            out[i] = net.langs[best], float(min(1.0, mean[best]))
        held.clear()

    n = 0
    for i, data in enumerate(texts):
        if data is None or not has_letter(data):
            continue
        if len(data) > size * room:
            out[i] = predict_text(net, data)
            continue
        w = windows_of(data, size)
        if n + len(w) > room:
            flush()
            n = 0
        held.append((i, w))
        n += len(w)
    flush()
    return out


def is_held_out(key: str) -> F.Column:
    """True where crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, p: LangParams, key: str, text: str, lang: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of the bounded sample.

    Ranks within a language are taken over hashes; Spark limits each task's rows per language
    before the shuffle, so a language of most rows costs no more than another. What reaches
    the driver is at most docs_per_lang * windows_per_doc windows for each language.
    """
    body = F.col(f"`{text}`")
    labelled = docs.select(
        F.xxhash64(F.col(f"`{key}`").cast("string"), body).alias("h"), F.col(f"`{lang}`").cast("string").alias("label"), body.alias("body")
    ).filter(body.isNotNull() & F.col(f"`{lang}`").isNotNull() & F.col(f"`{key}`").isNotNull() & ~is_held_out(key))
    order = Window.partitionBy("label").orderBy("h")
    # Of a language with n rows those with hashes in the lowest 4 * docs_per_lang / n can alone be chosen, so that
    # its tasks do not each send docs_per_lang rows to the one that ranks them.
    few = labelled.select("h", "label")
    counts = stash(labelled.groupBy("label").agg(F.count("*").alias("n")).withColumnRenamed("label", "to_label"), "language-counts")
    if counts.count() <= p.broadcast_langs:
        low = (F.col("h").cast("double") / float(1 << 64) + 0.5) * F.col("n") <= 4.0 * p.docs_per_lang + 64
        few = few.join(F.broadcast(counts), F.col("label") == F.col("to_label")).filter(low)
    chosen = few.select("h", "label").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= p.docs_per_lang).select("h").distinct()
    size, most = p.window, p.windows_per_doc

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("data").to_pylist():
                n = max(1, -(-len(data) // size))
                picks = sorted({i * n // most for i in range(most)})
                rows.append([data[i * size : (i + 1) * size] for i in picks])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array(rows, pa.list_(pa.binary()))], ["h", "label", "windows"])

    sample = labelled.join(F.broadcast(chosen), "h", "left_semi").select("h", "label", F.col("body").cast("binary").alias("data"))
    found = sample.mapInArrow(cut, "h bigint, label string, windows array<binary>").dropDuplicates(["h", "label"]).collect()
    found.sort(key=lambda r: (r.h, r.label))
    langs = sorted({r.label for r in found})
    place = {k: i for i, k in enumerate(langs)}
    pairs = [(bytes(w), place[r.label]) for r in found for w in r.windows if w and has_letter(bytes(w))]
    windows = np.zeros((len(pairs), size), np.uint8)
    for i, (w, _) in enumerate(pairs):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    return windows, np.array([k for _, k in pairs], np.int64), langs


def fit(docs: DataFrame, p: LangParams = LangParams(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteCNN | None:
    """A network trained on the rows that are not held out; None where none has a label and a letter."""
    windows, labels, langs = training_sample(docs, p, key, text, lang)
    return train(windows, labels, langs, p) if len(windows) else None


def predict(docs: DataFrame, net: ByteCNN | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, lang_pred and score of every row; only ``key`` and ``text`` are read.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a
    network. Equal texts get equal predictions, but for rounding of the score.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            found = predict_batch(net, texts) if net else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("held_out"), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["key", "held_out", "lang_pred", "score"],
            )

    inner = docs.select(F.col(f"`{key}`").alias("key"), is_held_out(key).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("data"))
    kind = inner.schema["key"].dataType.simpleString()
    return inner.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, p: LangParams = LangParams()) -> DataFrame:
    """Fit on ``docs`` and predict all of them."""
    return predict(docs, fit(docs, p))
