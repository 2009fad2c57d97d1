"""Quality rules by repetition coverage.

Each text is judged by the share of its characters that lie inside repeated word n-grams
(several lengths, found with rolling hashes in numpy) and inside repeated lines, on top of
two base rules. One narrow pass: no shuffle, and memory bounded by an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W


@dataclass(frozen=True)
class QualityRules:
    """Limits; a text that goes beyond one is not kept."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: (n, largest share of word characters inside repeated n-grams). The lengths and limits
    #: follow published repetition filters for web text.
    gram_limits: tuple[tuple[int, float], ...] = ((5, 0.40), (6, 0.38), (8, 0.36), (10, 0.34))
    max_line_share: float = 0.30
    symbols: bytes = b"#*$%&|<>"


MEASURES = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), ("gram_coverage", pa.float64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("verdict", pa.string()),
]
MEASURES_DDL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, gram_coverage double, base_failed boolean, kept boolean, verdict string"
)


def measure(data: bytes, rules: QualityRules) -> tuple:
    """The MEASURES of one text given as UTF-8."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends = W.word_bounds(buf)
    n = len(starts)
    # Code points up to each byte: continuation bytes do not count.
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = int(chars.sum())
    n_symbols = sum(data.count(bytes([s])) for s in rules.symbols)

    seen: set[bytes] = set()
    n_dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line and not line.isspace():
            seen.add(line)

    hashes = W.word_hashes(data)
    at = W.repeated(W.grams(hashes, rules.window))
    n_repeat = int(W.covered(at, rules.window, n).sum()) if len(at) else 0
    base_failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n

    verdict, worst = "", 0.0
    for width, limit in rules.gram_limits:
        at = W.repeated(W.grams(hashes, width))
        if not len(at):
            break  # without a repeated n-gram there is no repeated longer one
        share = float(chars[W.covered(at, width, n)].sum()) / max(1, word_chars)
        worst = max(worst, share)
        if share > limit and not verdict:
            verdict = f"gram{width}"
    if not verdict and dup_chars > rules.max_line_share * word_chars:
        verdict = "lines"
    if base_failed:
        verdict = "short" if n < rules.min_words else "windows"
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, dup_chars, worst, base_failed, not verdict, verdict or "kept"


def with_measures(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` of the MEASURES of its whole text.

    A null text counts as empty: no words, so base_failed. An empty table gives an empty
    result. All other columns pass through untouched, whatever their names, unless one is
    called ``quality``, which is replaced. Equal rows get equal measures.
    """
    carried = [c for c in docs.columns if c != "quality"]
    row = F.struct(*[F.col(f"`{c}`") for c in carried])
    return _measured(docs.select(row.alias("row")), carried.index(text), rules).select("row.*", "quality")


def _measured(rows: DataFrame, at: int, rules: QualityRules) -> DataFrame:
    """``rows`` (row: a struct whose field ``at`` is the text) with the struct column ``quality``."""
    row_type = rows.schema["row"].dataType.simpleString()
    kind = pa.struct([pa.field(k, t) for k, t in MEASURES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k for k, _ in MEASURES]
        for batch in batches:
            row = batch.column("row")
            found = [dict(zip(names, measure(d.as_py() or b"", rules), strict=True)) for d in row.field(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([row, pa.array(found, kind)], ["row", "quality"])

    return rows.mapInArrow(run, f"row {row_type}, quality struct<{MEASURES_DDL.replace(' ', ':').replace(',:', ',')}>")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their columns as they were."""
    return with_measures(docs, rules).filter("quality.kept").select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id and the measures of every document; only these two columns are read."""
    return with_measures(docs.select("doc_id", "text"), rules).select("doc_id", "quality.*")
