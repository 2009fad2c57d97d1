"""Fill-in-the-middle transformation with cuts at token boundaries.

A token is white space and the word behind it, or white space alone at the end of a text. Its end
is seen from two adjacent characters, so a text is cut into chunks that overlap by one byte: ends
are counted in all chunks of a batch of texts at once, prefix sums over a text's chunks lead both cut
ranks to the chunks that hold them, and these chunks alone are scanned again. One narrow pass over
the documents, no shuffle; beside the texts themselves only one group of chunks is held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


@dataclass(frozen=True)
class FimParams:
    seed: int = 42
    fim_percent: int = 50  # of the texts, those that are cut
    spm_percent: int = 80  # of the cut ones, those with the suffix first
    chunk: int = 1 << 14  # bytes
    group: int = 256  # chunks that are looked at together


# --- chunks ------------------------------------------------------------------------------


def ends_in(block: np.ndarray) -> np.ndarray:
    """Where tokens end: ``block`` holds bytes with one more behind each row, and the result says for
    each byte but the last of a row whether a token ends behind it. A word ends before white space."""
    space = SPACE[block]
    return ~space[..., :-1] & space[..., 1:]


def points_in(block: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (block & 0xC0) != 0x80


class Chunks:
    """The chunks of a batch of texts, with the number of token ends and code points in each.

    ``buf`` holds the texts end to end and a space behind each of them; ``starts`` and ``sizes`` say where.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: FimParams):
        self.buf, self.starts, self.sizes, self.width = buf, starts, sizes, p.chunk
        counts = -(-sizes // p.chunk)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.text_of = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(self.first[-1]) - self.first[self.text_of]
        self.begin = starts[self.text_of] + within * p.chunk
        self.size = np.minimum(p.chunk, starts[self.text_of] + sizes[self.text_of] - self.begin)
        self.n_ends, self.n_points = np.zeros(self.first[-1], np.int64), np.zeros(self.first[-1], np.int64)
        for at in range(0, int(self.first[-1]), p.group):
            some = slice(at, at + p.group)
            self.n_ends[some], self.n_points[some] = self._counted(self.begin[some], self.size[some])
        #: Ends and code points before each chunk, over the whole batch.
        self.ends_before, self.points_before = (np.concatenate([[0], np.cumsum(x)]) for x in (self.n_ends, self.n_points))

    def _counted(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of a group lie side by side, each with the byte behind it: no end is lost between two."""
        spans = size + 1
        edges = np.concatenate([[0], np.cumsum(spans)])
        flat = np.concatenate([self.buf[b : b + n] for b, n in zip(begin, spans, strict=True)])
        ends = np.concatenate([ends_in(flat), [False]])
        ends[edges[1:] - 1] = False  # the pair of two chunks is no pair of a text
        points = points_in(flat)
        points[edges[1:] - 1] = False  # the byte behind a chunk counts in the next one
        return np.add.reduceat(ends, edges[:-1], dtype=np.int64), np.add.reduceat(points, edges[:-1], dtype=np.int64)

    def tokens(self) -> np.ndarray:
        """The tokens of each text: its ends, and white space left over behind the last word."""
        found = self.ends_before[self.first[1:]] - self.ends_before[self.first[:-1]]
        last = self.buf[self.starts + np.maximum(self.sizes, 1) - 1]
        return found + ((self.sizes > 0) & SPACE[last])

    def cut(self, text: int, rank: int, n: int) -> tuple[int, int]:
        """(bytes, code points) of ``text`` before its token ``rank``, of n: only the chunk that holds the cut is scanned."""
        first, stop = self.first[text], self.first[text + 1]
        if rank <= 0 or rank >= n:
            return (0, 0) if rank <= 0 else (int(self.sizes[text]), int(self.points_before[stop] - self.points_before[first]))
        wanted = self.ends_before[first] + rank
        owner = int(np.searchsorted(self.ends_before[first : stop + 1], wanted)) - 1 + first
        begin, size = self.begin[owner], self.size[owner]
        ends = np.flatnonzero(ends_in(self.buf[begin : begin + size + 1]))
        stop_at = int(ends[wanted - self.ends_before[owner] - 1]) + 1
        points = self.points_before[owner] - self.points_before[first] + int(np.count_nonzero(points_in(self.buf[begin : begin + stop_at])))
        return int(begin - self.starts[text]) + stop_at, int(points)


# --- texts -------------------------------------------------------------------------------


def draws(key: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the sha256 of seed and key, as numbers. A null key is empty."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def assembled(data: bytes, form: str, a: int, b: int) -> bytes:
    """The text as ``form`` has it, cut behind bytes a and b."""
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)) if form == "spm" else data


#: Bytes of texts that are laid end to end at once; a longer text stands alone.
TOGETHER = 8 << 20


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most TOGETHER bytes, or of one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > TOGETHER:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def transformed(texts: list[bytes], h: np.ndarray, p: FimParams) -> Iterator[tuple[int, str, int | None, int | None, int | None, bytes]]:
    """n, form, code points of prefix, middle and suffix (None if plain), and output of every text, with its four draws in ``h``."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    sizes = np.array([len(t) for t in texts], np.int64)
    found = Chunks(np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts, sizes, p)
    for i, (text, n) in enumerate(zip(texts, found.tokens().tolist(), strict=True)):
        h1, h2, h3, h4 = h[i].tolist()
        if not text or h3 % 100 >= p.fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            yield n, "plain", None, None, None, text
            continue
        form = "spm" if h4 % 100 < p.spm_percent else "psm"
        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a, a_points), (b, b_points), (_, points) = (found.cut(i, rank, n) for rank in (one, two, n))
        yield n, form, a_points, b_points - a_points, points - b_points, assembled(text, form, a, b)


FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, suffix_chars bigint, output string"


def transform(docs: DataFrame, p: FimParams = FimParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``fim``: n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and
    suffix_chars (code points, null if plain) and output (the new text).

    A null text is an empty one; an empty text, one with a marker in it and those that the draws leave
    out are plain, and their output is the text. Draws hang on ``key`` alone, so rows that share a key
    and a text have the same output; a null key draws as an empty one. Columns pass through untouched,
    whatever their names, unless one is called ``fim``, which is replaced. An empty table gives an empty one.
    """
    carried = [c for c in docs.columns if c != "fim"]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.array(*draws(key, p.seed)).alias("h"))
    at, kind = carried.index(text), given.schema["row"].dataType.simpleString()
    made = pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FIELDS.split(", ")])
    names = [f.name for f in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("row").field(at)
            data = data.cast(pa.binary()) if data.type != pa.null() else pa.nulls(len(data), pa.binary())
            h = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            sizes = np.array([0 if v is None else v for v in pc.binary_length(data).to_pylist()], np.int64)
            for first, stop in _groups(sizes):
                texts = [d or b"" for d in data.slice(first, stop - first).to_pylist()]
                columns = list(zip(*transformed(texts, h[first:stop], p), strict=True))
                arrays = [pa.array(c, f.type if f.name != "output" else pa.binary()).cast(f.type) for c, f in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, stop - first), pa.StructArray.from_arrays(arrays, names)], ["row", "fim"])

    out = given.mapInArrow(run, f"row {kind}, fim struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    return out.select("row.*", "fim")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone. A cut text holds no marker, and no
    piece's end and a marker's begin make another one, so the output parts at exactly three."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, p: FimParams = FimParams()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""
    made = transform(docs.select("doc_id", "text"), p).select("doc_id", "fim.*")
    output, back = F.col("output"), restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "suffix_chars", digest(output).alias("output_sha256"), digest(back).alias("restored_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::varchar, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2,
  ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(t[1:one], '') AS pre, array_to_string(t[one + 1:two], '') AS mid, array_to_string(t[two + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  CASE WHEN form <> 'plain' THEN length(suf) END AS suffix_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
