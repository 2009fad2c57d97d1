"""Toxicity: features, trees and calibration against plain code, held-out accuracy, and what is never an input."""

import math
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity as T

SF = "/root/testdata/sf0.1"
P = T.ToxicityParams()
WORD = re.compile("[A-Za-zÀ-῿₀-\U0010ffff]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)


def plain_features(text, entries, p=P):
    """NAMES of a text, word by word. ``entries``: (level, first bytes, weight)."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    n, chars = len(words), len(text)

    def weight(word):
        data = low(word).encode()
        return max([w for level, k, w in entries if (data[:8] == k if level == 8 else len(data) >= level and data[:level] == k)], default=0.0)

    def first8(word):
        return low(word).encode()[:8]

    weights = [weight(w) for _, _, w in words]
    hit = [i for i, w in enumerate(weights) if w > 0]
    second = [i for i, (_, _, w) in enumerate(words) if first8(w) in {s.encode()[:8] for s in T.SECOND_PERSON}]
    known = sum(first8(w) in {low(k).encode()[:8] for k in T.KNOWN} for _, _, w in words)
    capital = lambda c: "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×")
    is_letter = lambda c: WORD.fullmatch(c) is not None
    chains, mixed = [], 0
    for i in range(n - 1):
        gap = text[words[i][1] : words[i + 1][0]]
        if len(gap.encode()) <= 2 and all(g in "013457@$!*._-+" for g in gap):
            mixed += gap[0] in "013457@$!*"
            chains.append(i)
    disguised, i = 0, 0
    while i < len(chains):
        j = i
        while j + 1 < len(chains) and chains[j + 1] == chains[j] + 1:
            j += 1
        a, b = chains[i], chains[j] + 1
        if not any(weights[k] > 0 for k in range(a, b + 1)):
            raw = low(text[words[a][0] : words[b][1]])
            word = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in raw if c not in "*._-+")
            cut = word.encode()[:8]
            disguised += any(cut == k if level == 8 else len(cut) >= level and cut[:level] == k for level, k, _ in entries) or cut in {low(k).encode()[:8] for k in T.KNOWN}
        i = j + 1
    single = [len(w) == 1 for _, _, w in words]
    spaced, run = 0, 0
    for s in [*single, False]:
        run = run + 1 if s else (spaced := spaced + (run if run >= 4 else 0)) * 0
    sign = lambda c: 32 < ord(c) < 127 and not c.isalnum()
    data, low_data = text.encode(), low(text).encode()
    letter_byte = b"".join((b"\1" if is_letter(c) else b"\0") * len(c.encode()) for c in text)
    w, c = max(1, n), max(1, chars)
    near = sum(any(abs(h - s) <= p.near for s in second) for h in hit)
    return [
        len(hit) / w, sum(weights) / w, math.log1p(len(hit)), len({first8(words[h][2]) for h in hit}) / math.sqrt(w),
        max((sum(h <= k < h + p.window for k in hit) for h in hit), default=0) / p.window, known / w, disguised / w, len(second) / w, near / max(1, len(hit)),
        sum(map(capital, text)) / max(1, sum(map(is_letter, text))), sum(len(x) >= 2 and all(map(capital, x)) for _, _, x in words) / w,
        text.count("!") / c, text.count("?") / c, sum(map(sign, text)) / c, sum(sign(a) and a == b for a, b in zip(text, text[1:], strict=False)) / c,
        mixed / w, sum(letter_byte[i] and low_data[i] == low_data[i - 1] == low_data[i - 2] for i in range(2, len(data))) / w, spaced / w, math.log1p(n), sum(map(is_letter, text)) / w,
    ]


ENTRIES = [(4, b"scum", 2.0), (5, b"idiot", 3.5), (8, b"trash", 1.5), (8, b"worthles", 2.5), (6, "réeux".encode(), 4.0), (7, b"achlich", 1.0)]
LEXICON = T.Lexicon.of([(level, int.from_bytes(k.ljust(8, b"\0"), "big"), w) for level, k, w in ENTRIES])


def drawn(seed, n):
    rng = random.Random(seed)
    some = ["idiot", "Idiots", "IDIOT!!", "trash", "trashy", "scumbag", "you", "YOU", "du", "tú", "RÉEUXMENT", "réeu", "worthless", "id1ot", "i.d.i.o.t", "m0ron", "st*pid", "tr@sh", "achlichen"]
    some += ["the", "a", "b", "c", "d", "Äpfel", "ñandú", "日本", "«non»", "“trash”", "co-op", "e.g.", "x@y.org", "soooo", "??", "!!!", "1,000", "…", " you ", "$$$", "f**k", "é", "×", "ß"]
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "\n", "é", "!", "idiot", "you idiot", "a b c d", "a b c", "aaa", "ÉÉ"]


def test_features_against_plain_code():
    for text in drawn(1, 400):
        assert T.features(text.encode(), LEXICON, P) == pytest.approx(plain_features(text, ENTRIES), abs=1e-9), text


def test_a_text_in_pieces_has_the_same_features(monkeypatch):
    from quern.llm import words

    texts = [" ".join(t.split()) for t in drawn(2, 60)]
    whole = [T.features(t.encode(), LEXICON, P) for t in texts]
    pieces = words.pieces
    monkeypatch.setattr(words, "pieces", lambda data: pieces(data, 16))
    for t, want in zip(texts, whole, strict=True):
        got = T.features(t.encode(), LEXICON, P)
        # Runs of single letters, and chains that signs join, do not go over a piece's end; pieces end at spaces.
        same = [i for i, name in enumerate(T.NAMES) if name != "spaced_letters"]
        assert got[same] == pytest.approx(want[same], abs=1e-9), t


def test_entries_of_a_text():
    found = T.entries_of("Idiot, RÉEUX the the".encode())
    assert {int(k).to_bytes(8, "big").rstrip(b"\0") for k in found[8]} == {b"idiot", "réeux".encode(), b"the"}
    assert {int(k).to_bytes(8, "big").rstrip(b"\0") for k in found[5]} == {b"idiot", "réeu".encode()}
    assert len(found[7]) == 0 and all(len(v) == 0 for v in T.entries_of(b"").values())


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        s, y, w = rng.integers(0, 6, n).astype(float), rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        starts, values = T.isotonic(s, y, w)
        assert (np.diff(values) > 0).all() and (np.diff(starts) > 0).all()
        got = values[np.searchsorted(starts, s, side="right") - 1]
        # The largest lower mean and the smallest upper mean over intervals meet at the solution.
        kinds = sorted(set(s.tolist()))
        mean = lambda a, b: (y * w)[(s >= a) & (s <= b)].sum() / w[(s >= a) & (s <= b)].sum()
        for v, g in zip(s.tolist(), got.tolist(), strict=True):
            assert g == pytest.approx(max(min(mean(a, b) for b in kinds if b >= v) for a in kinds if a <= v))


def test_one_tree_against_plain_search():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 2] > 3)).astype(float)
    p = replace(P, trees=1, depth=1, bins=32, min_weight=0.5)
    made = T.boost(x, y, p)
    prob = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - prob, np.full(len(y), prob * (1 - prob))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.l2)
    best = max((score(x[:, j] <= t) + score(x[:, j] > t), j, t) for j in range(3) for t in range(4))
    assert score(x[:, made.feature[0][0]] <= made.threshold[0][0]) + score(x[:, made.feature[0][0]] > made.threshold[0][0]) == pytest.approx(best[0])
    left = x[:, made.feature[0][0]] <= made.threshold[0][0]
    for m, leaf in ((left, 0), (~left, 1)):
        assert made.leaf[0][leaf] == pytest.approx(p.rate * g[m].sum() / (h[m].sum() + p.l2))
    deep = T.boost(x, y, replace(P, trees=60, depth=2, min_weight=0.5))
    assert ((deep.raw(x) > 0) == (y == 1)).all()


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    kinds, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    top = np.cumsum(count)
    rank = (top - (count - 1) / 2)[inverse]
    assert len(order) == len(rank)
    n1 = y.sum()
    return (rank[y].sum() - n1 * (n1 + 1) / 2) / (n1 * (~y).sum())


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    return docs, labels, model, T.predict(docs, model).toPandas()


def test_held_out_accuracy(scored):
    docs, labels, _, rows = scored
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    y = held.toxic.to_numpy() == 1
    assert auc(held.score.to_numpy(), y) >= 0.99
    assert (held.predicted.to_numpy()[y] == 1).mean() >= 0.9 and (held.predicted.to_numpy()[~y] == 1).mean() <= 0.005
    assert ((held.score.to_numpy() - y) ** 2).mean() <= 0.02


def test_scores_come_from_texts_and_training_labels_alone(spark, scored):
    docs, labels, model, rows = scored
    few = docs.filter("doc_id < 300")
    other = few.selectExpr("doc_id", "text", "'zz' as lang", "1 as toxic", "null as source", "2 as key", "3 as score")
    want = {r.doc_id: r.score for r in rows[rows.doc_id < 300].itertuples()}
    assert {r.doc_id: r.score for r in T.predict(other, model).collect()} == want
    # What held-out rows are labelled changes nothing.
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.fit(docs, turned)
    x = np.array([T.features((r.text or "").encode(), model.lexicon, P) for r in few.collect()])
    assert (again.scores(x) == model.scores(x)).all()


def test_edges(spark):
    rows = [(i, f"word {'idiot ' * (i % 2 * 3)}text number {i % 7} of some more words") for i in range(200)]
    rows += [(1, rows[1][1]), (None, "you idiot"), (500, None), (501, ""), (502, "idiot " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(1), "score": F.lit("x"), "held_out": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (3, None), (None, 1), (900, 1)], "doc_id bigint, toxic int").withColumn("lang", F.lit("zz"))
    got = T.report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "lexicon_density"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert by[None].held_out is False and by[None].predicted == 1 and by[502].predicted == 1 and by[500].score == by[501].score
    assert all(by[i].predicted == i % 2 for i in range(200))
    assert T.report(docs.limit(0), labels).count() == 0
    for kept, score in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert {r.score for r in T.report(docs, kept).collect()} == {score}


def test_the_sample_is_bounded_whatever_a_key_repeats(spark):
    docs = spark.range(2000).selectExpr("id % 40 as doc_id", "concat('text ', id) as text")
    labels = spark.range(3000).selectExpr("id % 40 as doc_id", "cast(id % 40 % 2 as int) as toxic")
    sample, counts = T.training_rows(docs, labels, replace(P, rows_per_label=5), "doc_id", "text", "toxic")
    kept = sample.collect()
    assert len(kept) == 10 and len({r.id for r in kept}) == 10 and sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
