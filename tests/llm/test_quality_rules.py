"""Quality rules against a plain re-statement of each base measure."""

import random
import re

import pytest

from quern.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    marked = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked), n < 20 or 100 * len(marked) > 30 * n


TEXTS = [
    None, "", " \t\n", "one two", "é ü x" * 30, "  wide space " * 5, "a b c d e f g h " * 9, "# * $ % & | < > " * 4,
    "same line here\nsame line here\n\n\nsame line here \n" + " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 37}" for i in range(5000)), "x" * 3_000_000, "ab " * 700_000,
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(12)), "\x1c\x1d\x85 a\x0bb\x0cc\rd",
]


def test_base_measures_match_plain(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, TEXTS[7]), (100, TEXTS[7])]
    got = {r.doc_id: r for r in Q.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), (i, (t or "")[:40])
        assert not (r.base_failed and r.kept)


def plain_verdict(text, rules):
    """Coverage and verdict by words and sets, n-gram by n-gram."""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    shares = []
    for width, limit in rules.gram_limits:
        at = {}
        for i in range(len(words) - width + 1):
            at.setdefault(tuple(words[i : i + width]), []).append(i)
        marked = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + width)}
        shares.append((sum(len(words[j]) for j in marked) / max(1, chars), limit, f"gram{width}"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    base = plain(text)
    if base[-1]:
        verdict = "short" if base[0] < rules.min_words else "windows"
    else:
        verdict = next((name for share, limit, name in shares if share > limit), "lines" if dup > rules.max_line_share * chars else "kept")
    return dup, max(s for s, _, _ in shares), verdict


def test_coverage_and_verdict_match_plain():
    rng, rules, seen = random.Random(11), Q.QualityRules(), set()
    for _ in range(400):
        pool = [f"{'é' if rng.random() < 0.2 else 'w'}{rng.randint(0, 10 ** rng.randint(1, 6))}" for _ in range(rng.randint(5, 60))]
        words = [rng.choice(pool) if rng.random() < 0.2 else f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(0, 8)):
            at, n = rng.randrange(len(words)), rng.choice([5, 6, 7, 8, 10, 14])
            words[at:at] = words[rng.randrange(len(words)) :][:n]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        lines += [rng.choice(lines)] * rng.choice([0, 0, 1, 3, 9])
        if rng.random() < 0.3:
            lines = ["same few words"] * rng.randint(1, 60) + lines
        text = "\n".join(lines)
        found, want = Q.measure(text.encode(), rules), plain_verdict(text, rules)
        assert (found[5], found[9]) == (want[0], want[2]) and abs(found[6] - want[1]) < 1e-9
        seen.add(found[9])
    assert {"kept", "short", "windows", "gram5"} <= seen


def test_coverage_rejects_repeats_and_keeps_clean():
    rules = Q.QualityRules()
    clean = " ".join(f"w{i}" for i in range(300))
    assert Q.measure(clean.encode(), rules)[8]
    # Runs of five repeated words never make an eight-word repeat, but cover the text.
    loop = " ".join(f"a b c d e u{i}" for i in range(60))
    found = Q.measure(loop.encode(), rules)
    assert not found[7] and not found[8] and found[9] == "gram5"
    lines = "\n".join(["alpha beta gamma"] * 40 + [f"x{i} y{i} z{i}" for i in range(30)])
    assert not Q.measure(lines.encode(), rules)[8]


def test_stage_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5, "q"), (2, " ".join(f"w{i}" for i in range(50)), None, None)], "doc_id bigint, text string, row int, quality string")
    out = Q.keep_good(df)
    assert out.columns == df.columns
    assert [r.doc_id for r in out.collect()] == [2]
    assert Q.keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [4, 7, 64])
def test_pieces_never_cut_a_word(size):
    from quern.llm.words import pieces

    data = b"aa bb  cccccccccccc d\n" * 9 + b"e" * 300
    cut = list(pieces(data, size))
    assert b"".join(cut) == data
    assert [w for p in cut for w in p.split()] == data.split()
