"""Packing: the ids are the library's, and every id lies in exactly one piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import sequence_packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World!! it's x's. a.b abc1. 12,5", "ÉCOLE déjà Straße ÷× Ünïcode, naïve. ß ÿ", "J̌J̌ é ÉÅ",
    "<|endoftext|> and foo<|startoftext|>bar <|ENDOFTEXT|>", "nb sp thin sp 　wide", "Σίσυφος ΣΣ. İstanbul KelvinK", "日本語。テスト、", "\U0001f600.. …. a… b….",
    "x" * 50000, "ered*** of%%% to%%% inrent$$$ &&& ### a'll. we'd, 'tis", "a\x0bb\x0cc\rd\te\nf\x1cg\x85h", "w. " * 9000, "tok " * 2047, "#1.# $2.50, 'S 'T.", "don''t!?;: \"x\".",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    words = P.WordIds(PATH, 100, 10_000_000)
    for _ in range(2):
        for text, got in zip(TEXTS, words.many([(t or "").encode() for t in TEXTS], 1), strict=True):
            assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids + [1], text
    rng = random.Random(3)
    small = P.WordIds(PATH, 60, 10_000_000)
    vocabulary = [f"w{i}a," for i in range(30)] + [f"rare{i}" for i in range(400)]
    for _ in range(40):
        text = " ".join(rng.choice(vocabulary[:30] if rng.random() < 0.7 else vocabulary) for _ in range(60))
        assert small.many([text.encode()], 1)[0].tolist() == library.encode(text, add_special_tokens=False).ids + [1]
    assert len(small.index) < 300
    alphabet = "aAbZ zé É.ß,;'s \n\t!?*&#1 9<>|Å '…ñ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for text, got in zip(texts, words.many([t.encode() for t in texts], 1), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids + [1], text


def check(rows, ids_of, window=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        ids = np.array(ids_of[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids_of[r.doc_id])
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids_of[doc])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        assert len({r.step_group for r in own}) == 1
    return padding, sequences


def test_pieces_cover_every_id_once(spark, library):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(f"w{rng.randint(0, 999)}" for _ in range(int(rng.paretovariate(0.6) * 9) % 4000)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id int, text string, key string, start int").repartition(5)
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for p in (P.Packing(), P.Packing(group_tokens=3000, step_sequences=4)):
        padding, sequences = check(P.pack(df, PATH, p).collect(), ids_of)
        assert padding == 0
        groups = defaultdict(set)
        for s, own in sequences.items():
            groups[own[0].step_group].add(s)
        assert max(map(len, groups.values())) <= p.step_sequences + 1
    with_ids = P.pack(df, PATH, with_ids=True).collect()
    assert all(r.ids == ids_of[r.doc_id][r.start : r.start + r.length] for r in with_ids)
    assert P.pack(df.limit(0), PATH).count() == 0


def test_every_tier_has_sequences_of_its_size():
    rng = random.Random(4)
    sizes = [int(rng.paretovariate(0.7) * 40) % 5000 + 1 for _ in range(4000)]
    packer = P.Packer((256, 512, 1024, 2048))
    for doc, n in enumerate(sizes):
        packer.add(doc, n)
        if doc % 500 == 499:
            packer.pack()
    packer.pack()
    rest = sum(packer.held)
    by_size, pieces = defaultdict(list), defaultdict(list)
    for sequence in packer.done:
        by_size[sum(n for _, _, n in sequence)].append(sequence)
        for doc, start, n in sequence:
            pieces[doc].append((start, n))
    assert set(by_size) == {256, 512, 1024, 2048} and rest < 2048
    # A sequence is opened by a piece that needs its size.
    for size, below in ((512, 256), (1024, 512), (2048, 1024)):
        assert all(below < s[0][2] <= size for s in by_size[size])
    # Gaps of the long windows are filled from shorter tiers.
    assert sum(len(s) > 1 for s in by_size[2048]) > 20
    packer.finish()
    for sequence in packer.done[sum(map(len, by_size.values())) :]:
        for doc, start, n in sequence:
            pieces[doc].append((start, n))
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == n


def test_equal_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id bigint, text string")
    rows = P.pack(df, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 6 and sum(r.length for r in rows) == 7


def test_kept_words_go_when_the_worker_is_idle():
    import time

    kept = P._Kept()
    at = (PATH, 100, 1000)
    words = kept.take(at)
    kept.give(at, words, 0.2)
    assert kept.take(at) is words
    time.sleep(0.5)  # taken again in time: nothing is dropped under a task
    kept.give(at, words, 0.1)
    time.sleep(0.5)
    assert not kept.held and kept.take(at) is not words


def test_step_groups_balance():
    rng = random.Random(2)
    lengths = [[rng.randint(1, 2048)] for _ in range(160)]
    of = P.step_groups(lengths, 16)
    cost = defaultdict(int)
    for n, g in zip(lengths, of, strict=True):
        cost[g] += n[0] ** 2
    assert len(cost) == 10 and max(cost.values()) < 1.1 * min(cost.values())


def test_ids_beyond_two_bytes(spark, library, tmp_path):
    """A vocabulary of the same pieces under larger numbers."""
    import json

    with open(PATH, encoding="utf-8") as f:
        given = json.load(f)
    by = 60_000
    given["model"]["vocab"] = {k: v + by for k, v in given["model"]["vocab"].items()}
    for t in given["added_tokens"]:
        t["id"] += by
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(given, f)
    texts = ["some plain words", "größer, ñandú & 日本語!", "", "e\u0301 <|x|> combined", "42 " * 900]
    for p, end, more in ((path, 1, by), (PATH, 70_000, 0)):
        found = P.WordIds(p, 1000, 100_000).many([t.encode() for t in texts], end)
        for t, ids in zip(texts, found, strict=True):
            assert ids.tolist() == [i + more for i in library.encode(t, add_special_tokens=False).ids] + [end]
    rows = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    for i, t in enumerate(texts):
        ids = np.array([x + by for x in library.encode(t, add_special_tokens=False).ids] + [1], "<u4")
        for r in (r for r in rows if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
