"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a learned and of a fixed lexicon, how near to its words the second person
stands, capitals, punctuation, and signs of obfuscation. Lexicon, trees and calibration are
fitted on a bounded sample of labelled rows (``rows_per_label`` of each label, chosen by hash); counts of lexicon
entries are aggregated by Spark, and a few thousand candidates and one small row of numbers for each
sampled text reach the driver. The lexicon that gives a sampled row its features is learned
without the row's fold, and calibration uses scores of trees that have not seen it. Prediction
runs over every whole text in one narrow pass; the model is some KB in the closure.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.session import stash


@dataclass(frozen=True)
class ToxicityParams:
    rows_per_label: int = 3000
    folds: int = 3
    lexicon: int = 300  # entries
    candidates: int = 4000  # entries that the driver chooses from
    min_docs: int = 4  # texts of label 1 that have an entry
    min_lift: float = 5.0  # times as frequent among label 1
    near: int = 6  # words
    window: int = 50  # words
    trees: int = 80
    depth: int = 3
    bins: int = 32
    rate: float = 0.15
    min_weight: float = 2.0  # hessian of a leaf
    l2: float = 1.0


# --- bytes -------------------------------------------------------------------------------

#: Insults that are known beforehand, in four languages.
KNOWN = (
    "idiot idiots idiotic stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb jerk garbage vermin "
    "dummkopf trottel abschaum versager widerlich vollidiot imbécile connard abruti ordure minable crétin imbécil estúpido estúpida basura escoria"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton vous votre tú ti vosotros usted ustedes".split()

_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
ASCII_LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122))
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
PUNCTUATION = (_BYTE > 32) & (_BYTE < 127) & ~ASCII_LETTER & ~DIGIT
#: What stands for a letter, or between letters, in a word that is disguised.
STANDS_FOR = dict(zip(b"013457@$!", b"oieastasi", strict=True))
DISGUISE = np.isin(_BYTE, list(STANDS_FOR) + list(b"*"))
BETWEEN = DISGUISE | np.isin(_BYTE, list(b"._-+"))
_PLAIN = bytes(STANDS_FOR.get(b, b) for b in range(256))
#: Masks that keep the first k of eight bytes.
KEEP = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)
#: Entries are the first 4 to 7 bytes of words, or (level 8) the first 8 bytes, which are all of a shorter word.
LEVELS = (4, 5, 6, 7, 8)


def lowered(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower case of ASCII and Latin-1 letters, which bytes begin a capital)."""
    low, capital = buf.copy(), UPPER[buf]
    low[capital] += 32
    if len(buf) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        low[second] += 32
        capital[second - 1] = True
    return low, capital


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: ASCII ones and all beyond, but for U+0080-U+00BF and U+2000-U+207F (signs and spaces)."""
    found = ASCII_LETTER[buf] | (buf >= 0x80)
    two = np.flatnonzero(buf == 0xC2)
    for k in (0, 1):
        found[np.minimum(two + k, len(buf) - 1)] = False
    three = np.flatnonzero(buf == 0xE2)
    three = three[(three + 1 < len(buf)) & ((buf[np.minimum(three + 1, len(buf) - 1)] & 0xFE) == 0x80)]
    for k in (0, 1, 2):
        found[np.minimum(three + k, len(buf) - 1)] = False
    return found


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first eight bytes of each word as a number, how many of them it has)."""
    size = np.minimum(ends - starts, 8)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]
    return np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64) & KEEP[size], size


def key_of(word: str) -> int:
    return int.from_bytes(word.lower().encode()[:8].ljust(8, b"\0"), "big")


SECOND_KEYS = np.unique(np.array([key_of(w) for w in SECOND_PERSON], np.uint64))
KNOWN_KEYS = np.unique(np.array([key_of(w) for w in KNOWN], np.uint64))


@dataclass(frozen=True)
class Lexicon:
    """Sorted keys and weights of the entries of each level."""

    entries: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int, int, float]]) -> Lexicon:
        """From (level, key, weight)."""
        levels = {}
        for level in LEVELS:
            here = sorted((k, w) for at, k, w in rows if at == level)
            levels[level] = np.array([k for k, _ in here], np.uint64), np.array([w for _, w in here])
        return cls(levels)

    def weights(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The largest weight of the entries that each word has; 0 without one."""
        best = np.zeros(len(keys))
        for level, (known, weight) in self.entries.items():
            if len(known) and len(keys):
                cut = keys & KEEP[level]
                at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
                hit = (known[at] == cut) & ((sizes >= level) | (level == 8))
                best = np.maximum(best, np.where(hit, weight[at], 0.0))
        return best


NAMES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_distinct", "lexicon_peak", "known_density", "disguised_hits", "second_person", "near_second_person",
    "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "doubled_punctuation", "mixed_words", "stretched_letters", "spaced_letters", "words", "word_length",
)


def features(data: bytes, lexicon: Lexicon, p: ToxicityParams) -> np.ndarray:
    """NAMES of one whole text given as UTF-8, worked through in pieces cut at spaces."""
    n = hits = known = disguised = you = chars = n_letters = capitals = n_capital_words = mixed = stretched = spaced = 0
    weight = 0.0
    marks = np.zeros(4)  # !, ?, all punctuation, the same twice
    hit_at, you_at, distinct = [], [], [np.zeros(0, np.uint64)]
    for piece in W.pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        if not len(buf):
            continue
        low, capital = lowered(buf)
        letter = letters(buf)
        starts, ends = runs(letter)
        keys, sizes = word_keys(low, starts, ends)
        w = lexicon.weights(keys, sizes)
        at, second = np.flatnonzero(w > 0), np.flatnonzero(np.isin(keys, SECOND_KEYS))
        hits, weight, you = hits + len(at), weight + float(w.sum()), you + len(second)
        known += int(np.isin(keys, KNOWN_KEYS).sum())
        hit_at.append(at + n)
        you_at.append(second + n)
        distinct.append(W.distinct(np.concatenate([distinct.pop(), keys[at]])))
        begins = (buf & 0xC0) != 0x80
        chars += int(begins.sum())
        letter_begins = letter & begins
        n_letters += int(letter_begins.sum())
        capitals += int((capital & letter).sum())
        if len(starts):
            per_word = np.add.reduceat(np.concatenate([letter_begins, [0]]).astype(np.int64), np.stack([starts, ends], 1).ravel())[::2]
            capital_per_word = np.add.reduceat(np.concatenate([capital & letter, [0]]).astype(np.int64), np.stack([starts, ends], 1).ravel())[::2]
            n_capital_words += int(((per_word >= 2) & (capital_per_word == per_word)).sum())
            first, stop = runs(per_word == 1)
            spaced += int((stop - first)[(stop - first) >= 4].sum())
            gap = starts[1:] - ends[:-1]
            joined = (gap == 1) & BETWEEN[buf[ends[:-1]]]
            joined |= (gap == 2) & BETWEEN[buf[ends[:-1]]] & BETWEEN[buf[np.minimum(ends[:-1] + 1, len(buf) - 1)]]
            mixed += int((joined & DISGUISE[buf[ends[:-1]]]).sum())
            if joined.any():
                disguised += _disguised(low, starts, ends, joined, w > 0, lexicon)
        sign = PUNCTUATION[buf]
        marks += [(buf == 33).sum(), (buf == 63).sum(), sign.sum(), (sign[1:] & (buf[1:] == buf[:-1])).sum()]
        if len(buf) > 2:
            stretched += int((letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])).sum())
        n += len(starts)
    h, y = np.concatenate([np.zeros(0, np.int64), *hit_at]), np.concatenate([np.zeros(0, np.int64), *you_at])
    peak = int((np.searchsorted(h, h + p.window) - np.arange(len(h))).max()) if len(h) else 0
    near = 0
    if len(h) and len(y):
        after = np.searchsorted(y, h)
        gap = np.minimum(np.abs(y[np.minimum(after, len(y) - 1)] - h), np.abs(h - y[np.maximum(after - 1, 0)]))
        near = int((gap <= p.near).sum())
    per_word, per_char = max(1, n), max(1, chars)
    return np.array(
        [
            hits / per_word, weight / per_word, np.log1p(hits), len(distinct[0]) / np.sqrt(per_word), peak / p.window, known / per_word, disguised / per_word, you / per_word,
            near / max(1, hits), capitals / max(1, n_letters), n_capital_words / per_word, marks[0] / per_char, marks[1] / per_char, marks[2] / per_char, marks[3] / per_char,
            mixed / per_word, stretched / per_word, spaced / per_word, np.log1p(n), n_letters / per_word,
        ]
    )


def _disguised(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray, plain: np.ndarray, lexicon: Lexicon) -> int:
    """How many chains of letter runs that only signs part make a word of the lexicon, no run of them alone being one."""
    first, stop = runs(joined)  # a chain goes from run first to run stop
    found = 0
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        if plain[a : b + 1].any():
            continue
        raw = low[starts[a] : ends[b]].tobytes()
        word = raw.translate(_PLAIN, b"*._-+")[:8]
        key = np.array([int.from_bytes(word.ljust(8, b"\0"), "big")], np.uint64)
        size = np.array([len(word)])
        found += bool(lexicon.weights(key, size)[0] > 0 or key[0] in KNOWN_KEYS)
    return found


def entries_of(data: bytes) -> dict[int, np.ndarray]:
    """The distinct keys of a text's words, level by level."""
    found: dict[int, list[np.ndarray]] = {level: [np.zeros(0, np.uint64)] for level in LEVELS}
    for piece in W.pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        if not len(buf):
            continue
        keys, sizes = word_keys(lowered(buf)[0], *runs(letters(buf)))
        for level in LEVELS:
            cut = keys if level == 8 else keys[sizes >= level] & KEEP[level]
            found[level] = [W.distinct(np.concatenate([*found[level], cut]))]
    return {level: arrays[0] for level, arrays in found.items()}


# --- trees -------------------------------------------------------------------------------


class Trees:
    """Boosted trees for the log-odds: each is complete, with ``depth`` levels of (feature, threshold) and a value a leaf."""

    def __init__(self, start: float, depth: int):
        self.start, self.depth = start, depth
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, p: ToxicityParams) -> Trees:
    """Second-order boosting of the logistic loss over histograms of at most ``bins`` quantiles a feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    made = Trees(float(np.log(share / (1 - share))), p.depth)
    score, inner = np.full(len(y), made.start), (1 << p.depth) - 1
    for _ in range(p.trees):
        prob = sigmoid(score)
        g, h = y - prob, prob * (1 - prob)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(p.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            local = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                slot, size = local * (len(e) + 1) + binned[:, j], width * (len(e) + 1)
                left_g, left_h = (np.cumsum(np.bincount(slot, v, size).reshape(width, -1), axis=1) for v in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                lg, lh = left_g[:, :-1], left_h[:, :-1]
                gain = lg**2 / (lh + p.l2) + (all_g - lg) ** 2 / (all_h - lh + p.l2) - all_g**2 / (all_h + p.l2)
                gain[(lh < p.min_weight) | (all_h - lh < p.min_weight)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best
                best[better] = value[better]
                f[first : first + width][better], t[first : first + width][better] = j, e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf_of = node - inner
        leaf = p.rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + p.l2)
        score = score + leaf[leaf_of]
        made.feature.append(f)
        made.threshold.append(t)
        made.leaf.append(leaf)
    return made


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest score of each step, its value): the rising steps nearest to ``y``, by pooling neighbours that fall."""
    order = np.argsort(score, kind="stable")
    kinds, first = np.unique(score[order], return_index=True)
    sums, weights = np.add.reduceat((y * weight)[order], first), np.add.reduceat(weight[order], first)
    steps: list[list[float]] = []
    for s, total, w in zip(kinds.tolist(), sums.tolist(), weights.tolist(), strict=True):
        steps.append([s, total, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, total, w = steps.pop()
            steps[-1][1] += total
            steps[-1][2] += w
    return np.array([s for s, _, _ in steps]), np.array([t / w for _, t, w in steps])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]
    share: float  # what a model without trees says
    p: ToxicityParams

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the trees' own probability keeps the order within a step."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        at = np.maximum(np.searchsorted(self.steps[0], raw, side="right") - 1, 0)
        return np.clip(0.999 * self.steps[1][at] + 0.001 * sigmoid(raw), 0.0, 1.0)


# --- tables ------------------------------------------------------------------------------


def is_held_out(key: str) -> F.Column:
    """True where crc32 of the key as text can be divided by 5; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, toxic, fold, data of the sampled texts; rows of each label among all).

    Rows are chosen among labels, by hash and at most ``rows_per_label`` a label: only their ids, in a broadcast of
    that size, meet the documents. An id with several labels is toxic if one says so; of several
    documents with one id the smallest text is taken, by a partial aggregate.
    """
    known = labels.select(F.col(f"`{key}`").cast("string").alias("id"), is_held_out(key).alias("out"), (F.col(f"`{label}`") != 0).cast("int").alias("toxic"))
    known = known.filter("id is not null and toxic is not null and not out").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stash(known.withColumn("h", F.xxhash64("id")), "toxicity-labels")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Of a label with n rows only those with the lowest hashes can be chosen: few rows are ranked, whatever n is.
    share = F.when(F.col("toxic") == 1, 1.0 / max(1, counts.get(1, 0))).otherwise(1.0 / max(1, counts.get(0, 0)))
    few = known.filter(F.col("h").cast("double") / float(1 << 64) + 0.5 <= (4.0 * p.rows_per_label + 64) * share)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "id"))).filter(F.col("r") <= p.rows_per_label)
    chosen = ranked.select("id", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(p.folds)).cast("int").alias("fold"))
    bodies = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("body"))
    found = bodies.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "fold").agg(F.min("body").alias("body"))
    return stash(found.select("id", "toxic", "fold", F.col("body").cast("binary").alias("data")), "toxicity-sample"), counts


def candidates(sample: DataFrame, p: ToxicityParams) -> tuple[list[tuple], np.ndarray]:
    """((level, key, texts of each (label, fold) that have it), ...), and the texts of each (label, fold)."""
    sizes = np.zeros((2, p.folds), np.int64)
    for r in sample.groupBy("toxic", "fold").count().collect():
        sizes[r.toxic, r.fold] = r["count"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, toxic, fold in zip(batch.column("data"), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                for level, keys in entries_of(data.as_py() or b"").items():
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, level, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(n, toxic * p.folds + fold, np.int32))], ["level", "key", "slot"]
                    )

    rows = sample.select("data", "toxic", "fold").mapInArrow(run, "level int, key bigint, slot int")
    names = [f"n{i}" for i in range(2 * p.folds)]
    counted = rows.groupBy("level", "key").agg(*[F.count_if(F.col("slot") == i).alias(c) for i, c in enumerate(names)])
    of = lambda k: sum((F.col(c) for c in names[k * p.folds : (k + 1) * p.folds]), F.lit(0))
    n1, n0 = int(sizes[1].sum()), int(sizes[0].sum())
    lift = (of(1) + 0.5) / (n1 + 1.0) / ((of(0) + 0.5) / (n0 + 1.0))
    gain = of(1) / float(max(1, n1)) - of(0) / float(max(1, n0))
    best = counted.filter((of(1) >= p.min_docs) & (lift >= p.min_lift / 2)).orderBy(F.desc(gain), "level", "key").limit(p.candidates).collect()
    return [(r.level, r.key & (1 << 64) - 1, np.array(r[2:]).reshape(2, p.folds)) for r in best], sizes


def lexicon_without(found: list[tuple], sizes: np.ndarray, fold: int | None, p: ToxicityParams) -> Lexicon:
    """The entries that part labels best, by the texts outside ``fold``; an entry's weight is its log-odds."""
    use = np.ones(p.folds, bool)
    if fold is not None and p.folds > 1:
        use[fold] = False
    n0, n1 = sizes[:, use].sum(axis=1)
    rows = []
    for level, key, counts in found:
        b, a = counts[:, use].sum(axis=1)
        lift = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
        both = (a + b) / max(1, n0 + n1)
        z = (a / max(1, n1) - b / max(1, n0)) / np.sqrt(max(1e-12, both * (1 - both) * (1 / max(1, n1) + 1 / max(1, n0))))
        if a >= p.min_docs * use.mean() and lift >= p.min_lift and z >= 4:
            rows.append((-z, level, key, float(np.log(lift))))
    return Lexicon.of([(level, key, w) for _, level, key, w in sorted(rows)[: p.lexicon]])


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model of the rows that are not held out. Where these have one label, or none, it says their share of label 1
    (0 without any) for every text. A sampled label whose id has no document counts for nothing."""
    sample, counts = training_rows(docs, labels, p, key, text, label)
    found, sizes = candidates(sample, p)
    present = sizes.sum(axis=1)
    whole = lexicon_without(found, sizes, None, p)
    if not present.all():
        return ToxicityModel(whole, None, (np.zeros(0), np.zeros(0)), float(present[1] > 0), p)
    own = [lexicon_without(found, sizes, f, p) for f in range(p.folds)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(d.as_py() or b"", own[f], p).tolist() for d, f in zip(batch.column("data"), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("fold"), pa.array(rows, pa.list_(pa.float64()))], ["id", "toxic", "fold", "x"])

    rows = sorted(sample.mapInArrow(run, "id string, toxic int, fold int, x array<double>").collect(), key=lambda r: r.id)
    x, y, fold = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), np.array([r.fold for r in rows])
    unseen = np.zeros(len(y))
    for f in range(p.folds):
        rest = fold != f
        if (~rest).any():
            unseen[~rest] = boost(x[rest], y[rest], p).raw(x[~rest]) if rest.any() else 0.0
    # Each label counts as often as among all labelled rows, not as in the sample.
    weight = np.where(y == 1, counts.get(1, 0) / present[1], counts.get(0, 0) / present[0])
    return ToxicityModel(whole, boost(x, y, p), isotonic(unseen, y, weight), 0.0, p)


def predict(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score, predicted and lexicon_density of every row; only ``key`` and ``text`` are read.

    A null text is an empty one; both have a score like any other. Rows with equal texts have equal
    scores. An empty table gives an empty one; columns of other names do not matter.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(d.as_py() or b"", model.lexicon, model.p) for d in batch.column("data")]).reshape(-1, len(NAMES))
            scores = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(x[:, 0])], ["key", "held_out", "score", "predicted", "lexicon_density"]
            )

    inner = docs.select(F.col(f"`{key}`").alias("key"), is_held_out(key).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("data"))
    kind = inner.schema["key"].dataType.simpleString()
    return inner.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int, lexicon_density double").withColumnRenamed("key", key)


def report(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Fit on ``docs`` and ``labels``, and score all documents."""
    return predict(docs, fit(docs, labels, p))
