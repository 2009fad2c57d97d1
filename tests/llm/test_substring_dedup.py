"""Substring dedup against brute force on small corpora, and its guarantees."""

import random

import numpy as np

from quern.llm import substring_dedup as S


def fresh(rng, n):
    return [f"w{rng.randint(0, 10**9)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, id int, row string")


def brute(rows, p):
    """Removed word spans, from the units of each document in the order of ids."""
    first = {}
    own = {}
    for i, text in rows:
        at, digests, n = S.units((text or "").encode(), p)
        own[i] = list(zip(at.tolist(), digests.tolist(), strict=True)), n
        for d in digests.tolist():
            first[d] = min(first.get(d, i), i)
    out = {}
    for i, (chosen, n) in own.items():
        mask, seen = [False] * n, set()
        for at, d in chosen:
            if first[d] < i or d in seen:
                mask[at : at + p.unit] = [True] * p.unit
            seen.add(d)
        spans, at = [], 0
        while at < n:
            end = at
            while end < n and mask[end]:
                end += 1
            if end - at >= p.min_words:
                spans.append((at, end))
            at = max(end, at + 1)
        out[i] = spans
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [fresh(rng, n) for n in (20, 30, 51, 80, 400)]
    rows = []
    for i in range(120):
        words = fresh(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((i, " ".join(words) if i % 5 else "\n".join(words)))
    rows += [(200, rows[7][1]), (201, None), (202, ""), (203, "short text")]
    p = S.SubstringDedup()
    want = brute(rows, p)
    got = S.dedup_substrings(table(spark, rows).repartition(6), p)
    assert got.columns == ["doc_id", "text", "id", "row", "removed", "removed_words"]
    texts = dict(rows)
    for r in got.collect():
        assert [(s.first_word, s.end_word) for s in r.removed] == want[r.doc_id]
        assert r.removed_words == sum(b - a for a, b in want[r.doc_id])
        words = (texts[r.doc_id] or "").split()
        kept = [w for i, w in enumerate(words) if not any(a <= i < b for a, b in want[r.doc_id])]
        assert (r.text or "").split() == kept and (r.text is None) == (texts[r.doc_id] is None)
        for s in r.removed:
            assert texts[r.doc_id][s.start : s.stop].split() == words[s.first_word : s.end_word]


def test_every_repeat_over_fifty_words_is_caught():
    p, rng = S.SubstringDedup(), random.Random(8)
    for _ in range(200):
        n = rng.randint(51, 90)
        passage = fresh(rng, n)
        a, b = fresh(rng, rng.randint(0, 90)) + passage + fresh(rng, rng.randint(0, 90)), fresh(rng, 40) + passage + fresh(rng, 40)
        found = S.spans(" ".join(b).encode(), S.units(" ".join(a).encode(), p)[1], p)
        assert len(found) == 1
        assert found[0][2] >= 40 and found[0][3] <= 40 + n and found[0][3] - found[0][2] >= n - 2 * (p.spread - 1)


def test_clean_texts_are_left_alone(spark):
    rng = random.Random(9)
    line = " ".join(fresh(rng, 27))
    rows = [(i, " ".join(fresh(rng, 60)) + "\n" + line + "\n" + " ".join(fresh(rng, 60))) for i in range(30)]
    assert S.dedup_substrings(table(spark, rows)).filter("removed_words > 0").count() == 0


def test_repeats_inside_a_text_and_shared_ids(spark):
    rng = random.Random(10)
    passage = " ".join(fresh(rng, 100))
    rows = [(1, f"{passage} é\n{passage}"), (2, None), (None, passage), (3, passage), (3, passage)]
    got = {}
    for r in S.dedup_substrings(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[None][0].removed_words == 0
    assert got[1][0].removed_words >= 2 * 78 and [r.removed_words >= 78 for r in got[3]] == [True, True]
    assert S.dedup_substrings(table(spark, rows).limit(0)).count() == 0
    upper = S.spans(passage.upper().encode(), S.units(passage.encode(), S.SubstringDedup())[1], S.SubstringDedup())
    assert len(upper) == 1


def test_long_text_in_runs_agrees():
    p, rng = S.SubstringDedup(), random.Random(11)
    data = " ".join(fresh(rng, 70_000) + ["a"] * 70_000).encode()
    at, digests, n = S.units(data, p)
    from quern.llm import words as W

    g = W.grams(W.word_hashes(data), p.unit)
    want = sorted({i + int(np.argmin(g[i : i + p.spread])) for i in range(0, 70_000, 1)})
    assert set(want) <= set(at.tolist()) and n == 140_000


def test_report_removes_repeats_whole(spark):
    """Passages of 28 words and more to both ends, wherever they begin; whole lines, paragraphs and texts from 12."""
    rng = random.Random(12)
    passage, line, paragraph, short = fresh(rng, 90), fresh(rng, 12), fresh(rng, 20), fresh(rng, 11)
    rows, want = [], []
    seen = [False] * 90  # of the passage, by 12-word units
    for i in range(60):
        a = rng.randint(0, 62)
        part = passage[a : a + rng.randint(28, 90)]
        before, after = fresh(rng, rng.randint(0, 40)), fresh(rng, rng.randint(0, 40))
        gone = [False] * len(part)
        for at in range(len(part) - 11):
            if seen[a + at]:
                gone[at : at + 12] = [True] * 12
            seen[a + at] = True
        stretches = "".join("x" if g else " " for g in gone).split(" ")
        assert all(len(s) == 0 or len(s) >= 12 for s in stretches)
        # Stretches under 28 words stay.
        at = 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end]:
                end += 1
            if end - at < 28:
                gone[at:end] = [False] * (end - at)
            at = max(end, at + 1)
        rows.append((i, " ".join(before + part + after)))
        want.append((before + [w for w, g in zip(part, gone, strict=True) if not g] + after, sum(gone)))
    for i in range(60, 64):
        own = [fresh(rng, 30), fresh(rng, 30), fresh(rng, 30)]
        text = [" ".join(own[0]), " ".join(line).upper() if i % 2 else "\t" + " ".join(line), " ".join(own[1]), "", " ".join(paragraph[:9]), " ".join(paragraph[9:]), "", " ".join(own[2]), " ".join(short)]
        rows.append((i, "\n".join(text)))
        want.append((own[0] + ([] if i > 60 else line) + own[1] + ([] if i > 60 else paragraph) + own[2] + short, 32 if i > 60 else 0))
    rows += [(64, " ".join(line)), (65, "é " + " ".join(line)), (66, rows[3][1]), (67, None), (68, " ".join(short)), (69, " ".join(short))]
    want += [([], 12), (["é", *line], 0), ([], len(rows[3][1].split())), ([], 0), (short, 0), (short, 0)]
    got = {r.doc_id: r for r in S.report(table(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for (i, text), (left, removed) in zip(rows, want, strict=True):
        assert ((got[i].text or "").split(), got[i].removed_words) == (left, removed), i
        for s in got[i].removed:
            assert text[s.start : s.stop].split() == text.split()[s.first_word : s.end_word]


def test_an_edge_is_found_in_any_earlier_text(spark):
    """The document that holds the edge is neither the keeper of the units beside it nor cut there itself."""
    rng = random.Random(13)
    for _ in range(3):
        passage = fresh(rng, 60)
        lead = rng.randint(1, 11)
        rows = [(1, " ".join(passage[lead:])), (2, " ".join(fresh(rng, 40) + passage)), (3, " ".join([*fresh(rng, 40), *passage, "end"]))]
        got = {r.doc_id: r for r in S.report(table(spark, rows)).collect()}
        assert got[2].removed_words == 60 - lead and got[3].removed_words == 60


def test_blocks_are_counted_once():
    p = S.SubstringDedup(block_words=2)
    first, end, digests = S.blocks(b"a b\nc\n\nd  E\n\nf\n", p)
    assert list(zip(first.tolist(), end.tolist(), strict=True)) == [(0, 2), (3, 5), (0, 3), (0, 6)] and len(set(digests.tolist())) == 4
    assert S.blocks(b"D\te", p)[2].tolist() == digests[1:2].tolist()
    assert [len(x) for x in S.blocks(b"a b", S.SubstringDedup())] == [0, 0, 0] == [len(x) for x in S.blocks(b"", p)]


def test_whole_repeats_go_and_nothing_else_does(spark):
    """Independent of the choice of units: every run of min_words that an earlier document has is gone, as is every
    line, paragraph or text of block_words; and what is gone stands in a unit or block had before."""
    rng = random.Random(21)
    shared = [fresh(rng, n) for n in (13, 28, 29, 51, 90, 300)]
    lines = [" ".join(fresh(rng, n)) for n in (5, 12, 20)]
    rows = []
    for i in range(90):
        words = fresh(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        text = " ".join(words)
        for _ in range(rng.randint(0, 2)):
            text += "\n" * rng.randint(1, 2) + rng.choice(lines)
        rows.append((i, text))
    rows += [(95, rows[3][1]), (96, rows[3][1].replace(" ", "  ")), (97, None)]
    p = S.WHOLE
    gone = {r.doc_id: {w for s in r.removed for w in range(s.first_word, s.end_word)} for r in S.dedup_substrings(table(spark, rows).repartition(5), p).collect()}

    def runs(words, n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def stretches(text):
        """(first word, words) of lines, paragraphs and the text."""
        at, out, paragraph, whole = 0, [], [], []
        for line in text.split("\n"):
            words = line.split()
            out.append((at, words))
            at += len(words)
            if words:
                paragraph += words
            else:
                out.append((at - len(paragraph), paragraph))
                paragraph = []
            whole += words
        return [(a, tuple(w)) for a, w in [*out, (at - len(paragraph), paragraph), (0, whole)] if len(w) >= p.block_words]

    long_before, units_before, blocks_before = set(), set(), set()
    for i, text in rows:
        words = (text or "").lower().split()
        must, may = set(), set()
        for at, run in enumerate(runs(words, p.min_words)):
            if run in long_before:
                must |= set(range(at, at + p.min_words))
        units_here = set()
        for at, run in enumerate(runs(words, p.unit)):
            if run in units_before or run in units_here:
                may |= set(range(at, at + p.unit))
            units_here.add(run)
        blocks_here = set()
        for at, block in sorted(stretches((text or "").lower()), key=lambda b: b[0]):
            if block in blocks_before or (at, block) not in blocks_here and block in {b for _, b in blocks_here}:
                must |= set(range(at, at + len(block)))
            blocks_here.add((at, block))
        assert must <= gone[i] <= may | must, (i, sorted(must - gone[i])[:5], sorted(gone[i] - may - must)[:5])
        long_before |= set(runs(words, p.min_words))
        units_before |= units_here
        blocks_before |= {b for _, b in blocks_here}
    assert sum(map(len, gone.values())) > 1000 and len(gone[95]) == len(rows[3][1].split()) == len(gone[96])


def test_hot_digests_are_met_where_they_lie(spark, monkeypatch):
    rows = [(i, d) for i in range(300) for d in ([7] if i % 3 == 0 else []) + [1000 + i // 2, 5000 + i]]
    pairs = spark.createDataFrame(rows, "id bigint, digest bigint").repartition(5)
    first = {}
    for i, d in rows:
        first.setdefault(d, []).append(i)
    want = sorted((i, d, min(first[d])) for i, d in rows if len(first[d]) > 1)
    for one_in in (1, 20, 10**9):  # none is hot, the common one is, all are
        monkeypatch.setattr(S, "HOT_ONE_IN", one_in)
        got = S._met(pairs, S._shared(pairs))
        assert sorted((r.id, r.digest, r.keeper) for r in got.collect()) == want
