"""Hierarchical multi-length packing of tokenized documents.

A document's ids are cut into full windows and a remainder. Remainders go to the tier of the
smallest context size that holds them, and every tier is packed into sequences of its own
size, the longest first: each is opened by one of the tier's remainders, and its gap is
filled from this tier and the shorter ones, whole pieces first, the last one cut to fit. What
is left at the end of a task is laid out on powers of two. All sizes are full, so there is
no padding. Finished sequences of all sizes are dealt out to step groups of about equal
attention cost.

Every task packs what it reads: there is no shuffle, the ids are made once, and memory is
bounded by ``group_tokens`` and one Arrow batch. A repeated task packs the same way.
"""

from __future__ import annotations

import re
import threading
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)  # context sizes; the last is the window
    end_id: int = 1
    group_tokens: int = 1 << 20  # ids packed together, about
    step_sequences: int = 16  # sequences of a step group
    cache_words: int = 400_000  # words whose ids a worker keeps
    cache_ids: int = 2_000_000
    idle_seconds: float = 1.0  # without a task, after which a worker forgets them


# --- ids ---------------------------------------------------------------------------------

# ASCII marks that the tokenizer's pattern cuts from a letter or digit before them, and the
# bytes of Latin-1 letters.
_MARKS = b".,;:!?*&%$#"
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_LETTERS = re.compile(rb"(?:[a-z]|" + _LATIN + rb")+").fullmatch
_ENDS_IN_LETTER = re.compile(rb"(?:[a-z0-9]|" + _LATIN + rb")\Z").search


class WordIds:
    """Ids of texts by a word-end BPE file of ``tokenizers``, with the ids of words kept.

    The file's pre-tokenizer never joins what white space separates, and its normalizer acts
    within words, so a text's ids are those of its words in order; and a word that ends in
    marks after a letter has the ids of the two parts. Texts with combining marks (composing
    them depends on case) or with the lead of a special token go to the library whole.
    """

    def __init__(self, path: str, cache_words: int, cache_ids: int):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        # Words of letters alone are one piece: the model, which both share, takes them as they are.
        self.bare = Tokenizer(self.full.model)
        self.letters = _byte_letters()
        self.limits = cache_words, cache_ids
        #: Word to entry; an entry has two runs of the pool, the second often empty.
        self.index: dict[bytes, int] = {}
        self.runs = array("q")
        #: Ids take two bytes as far as the vocabulary's largest allows, else four.
        self.code, self.kind = id_type(max(self.full.get_vocab().values(), default=0))
        self.pool = array(self.code)
        self.used = np.zeros(0, np.int64)  # how often an entry has been looked up

    def shrink(self) -> None:
        """Forget the words met once or twice, and of the others what half the limits cannot hold, the rarest first."""
        table = np.frombuffer(self.runs, np.int64).reshape(-1, 4)
        order = np.argsort(-self.used, kind="stable")[: int((self.used >= 3).sum())]
        fits = np.cumsum(table[order, 1] + table[order, 3]) <= self.limits[1] // 2
        keep = np.sort(order[: min(int(fits.sum()), self.limits[0] // 2)])
        runs = table[keep]
        del table
        place = np.full(len(self.used), -1, np.int64)
        place[keep] = np.arange(len(keep))
        old = place.tolist()
        self.index = {w: old[i] for w, i in self.index.items() if i < len(old) and old[i] >= 0}
        flat = runs.reshape(-1, 2)
        n = flat[:, 1]
        ends = np.cumsum(n)
        at = np.repeat(flat[:, 0] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        pool = np.frombuffer(self.pool, self.kind)[at]
        table = np.column_stack([ends - n, n])
        self.runs, self.pool = array("q", table.tobytes()), array(self.code, pool.tobytes())
        self.used = self.used[keep] // 2

    def _add(self, keys: list[bytes], tool, texts: list[str]) -> None:
        for at in range(0, len(keys), 4096):
            found = [e.ids for e in tool.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
            first = len(self.runs) // 4
            self.index.update(zip(keys[at : at + 4096], range(first, first + len(found)), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            table = np.zeros((len(found), 4), np.int64)
            table[:, 0] = len(self.pool) + np.cumsum(lengths) - lengths
            table[:, 1] = lengths
            self.runs.frombytes(table.tobytes())
            self.pool.extend(chain.from_iterable(found))

    def _learn(self, words: Iterable[bytes]) -> None:
        index = self.index
        parts, single = [], []
        for w in words:
            core = w.rstrip(_MARKS)
            if len(core) < len(w) and core and _ENDS_IN_LETTER(core):
                parts.append((w, core, w[len(core) :]))
            else:
                single.append(w)
        known = {x for _, core, marks in parts for x in (core, marks)}
        new = [w for w in known.union(single) if w not in index]
        plain = [w for w in new if w.isalpha()]
        latin = [w for w in new if not w.isalpha() and _LETTERS(w)]
        shown = set(plain).union(latin)
        other = [w for w in new if w not in shown]
        self._add(plain, self.bare, [w.decode() for w in plain])
        self._add(latin, self.bare, [w.decode().lower().encode().decode("latin-1").translate(self.letters) for w in latin])
        self._add(other, self.full, [w.decode("utf-8", "replace") for w in other])
        if parts:
            whole, cores, marks = zip(*parts, strict=True)
            runs = np.frombuffer(self.runs, np.int64).reshape(-1, 4)
            rows = [np.fromiter(map(index.__getitem__, keys), np.int64, len(keys)) for keys in (cores, marks)]
            table = np.concatenate([runs[rows[0], :2], runs[rows[1], :2]], axis=1)
            del runs
            first = len(self.runs) // 4
            index.update(zip(whole, range(first, first + len(whole)), strict=True))
            self.runs.frombytes(table.tobytes())

    def many(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` after them."""
        if len(self.index) > self.limits[0] or len(self.pool) > self.limits[1]:
            self.shrink()
        whole: dict[int, np.ndarray] = {}
        cut: list[list[bytes]] = []
        for i, data in enumerate(texts):
            if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
                whole[i] = np.array(self.full.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)
                cut.append([])
            else:
                cut.append(data.lower().split())
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = list(chain.from_iterable(cut))
        del cut
        get = self.index.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            lost = [words[i] for i in missing]
            self._learn(set(lost))
            at[missing] = np.fromiter(map(get, lost), np.int64, len(lost))
        del words
        met = np.bincount(at, minlength=len(self.runs) // 4) if len(at) else np.zeros(len(self.runs) // 4, np.int64)
        met[: len(self.used)] += self.used
        self.used = met
        runs, pool = np.frombuffer(self.runs, np.int64).reshape(-1, 4)[at].reshape(-1, 2), np.frombuffer(self.pool, self.kind)
        n = runs[:, 1]
        ends = np.cumsum(n)
        flat = pool[np.repeat(runs[:, 0] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(n) else np.zeros(0, self.kind)
        edges = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(counts)])]
        end = id_type(end_id)[1](end_id)  # a wider one widens the text's
        return [np.append(whole[i] if i in whole else flat[edges[i] : edges[i + 1]], end) for i in range(len(texts))]


def id_type(largest: int) -> tuple[str, type]:
    """Type code and numpy type of ids up to ``largest``."""
    return ("H", np.uint16) if largest < 1 << 16 else ("I", np.uint32)


def _byte_letters() -> dict[int, int]:
    """The printable letters that byte-level vocabularies write bytes with: printable Latin-1
    stands for itself, all other bytes follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


# --- packing -----------------------------------------------------------------------------


class Packer:
    """Packs (doc, start, length) pieces into sequences. ``done`` holds finished sequences, each a list of pieces."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.window = tiers, tiers[-1]
        self.waiting: list[deque] = [deque() for _ in tiers]
        self.held = [0] * len(tiers)
        self.done: list[list[tuple[int, int, int]]] = []

    def add(self, doc: int, n: int) -> None:
        full = n - n % self.window
        self.done.extend([(doc, at, self.window)] for at in range(0, full, self.window))
        if n > full:
            self._wait((doc, full, n - full))

    def _wait(self, piece: tuple[int, int, int]) -> None:
        tier = bisect_left(self.tiers, piece[2])
        self.waiting[tier].append(piece)
        self.held[tier] += piece[2]

    def _pop(self, tier: int) -> tuple[int, int, int]:
        piece = self.waiting[tier].popleft()
        self.held[tier] -= piece[2]
        return piece

    def _take(self, gap: int, top: int) -> tuple[int, int, int] | None:
        """A waiting piece of at most ``gap``, from the longest tier up to ``top`` that has one at its head;
        else the head of the shortest tier, cut to fit, its rest waiting again."""
        for tier in range(top, -1, -1):
            queue = self.waiting[tier]
            if queue and queue[0][2] <= gap:
                return self._pop(tier)
        for tier in range(top + 1):
            if self.waiting[tier]:
                doc, start, n = self._pop(tier)
                self._wait((doc, start + gap, n - gap))
                return doc, start, gap
        return None

    def _fill(self, size: int, top: int) -> None:
        sequence, gap = [], size
        while gap and (piece := self._take(gap, top)):
            sequence.append(piece)
            gap -= piece[2]
        self.done.append(sequence)

    def pack(self) -> None:
        """Full sequences of every tier, as long as it and the shorter ones have enough for them."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.waiting[tier] and sum(self.held[: tier + 1]) >= self.tiers[tier]:
                self._fill(self.tiers[tier], tier)

    def finish(self) -> None:
        """The rest, less than a window, as sequences whose sizes are powers of two."""
        self.pack()
        size = self.window
        while held := sum(self.held):
            size //= 2
            if size <= held:
                self._fill(size, len(self.tiers) - 1)


def step_groups(lengths: list[list[int]], per_group: int) -> list[int]:
    """A group for each sequence: by falling attention cost (the sum of squared piece lengths),
    dealt forth and back, so that groups differ little in cost and by one sequence in size."""
    groups = max(1, -(-len(lengths) // per_group))
    order = sorted(range(len(lengths)), key=lambda i: (-sum(n * n for n in lengths[i]), i))
    out = [0] * len(lengths)
    for place, i in enumerate(order):
        turn, at = divmod(place, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


PIECE_DDL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, step_group bigint"
#: Ids of a task's sequences and step groups begin at its partition times this.
TASK_SPAN = 1 << 40


def pack(docs: DataFrame, tokenizer: str, p: Packing = Packing(), key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: ``key``, PIECE_DDL and, with ``with_ids``, the piece's ids.

    A null text is an empty one and has the end id alone. Equal rows are documents of their
    own. An empty table has no pieces. Other columns are not read. ``tokenizer`` is the path
    of the vocabulary file, the same on all machines.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (tokenizer, p.cache_words, p.cache_ids)
        words = _take_ids(kept)
        base = TaskContext.get().partitionId() * TASK_SPAN
        packer, ids, keys = Packer(p.tiers), {}, {}
        given = sequences = groups = fresh = 0

        def emit(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            steps = step_groups([[n for _, _, n in s] for s in packer.done], p.step_sequences)
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            for number, sequence in enumerate(packer.done):
                offset = 0
                for doc, start, n in sequence:
                    piece = ids[doc][start : start + n].astype("<u4")
                    rows.append((keys[doc], start, n, zlib.crc32(piece.tobytes()), len(ids[doc]), base + sequences + number, offset, base + groups + steps[number]))
                    if with_ids:
                        parts.append(piece)
                    offset += n
            sequences += len(packer.done)
            groups += max(steps, default=-1) + 1
            packer.done = []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            names = ["key", *[f.split()[0] for f in PIECE_DDL.split(", ")]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
            # What still waits goes on to the next group.
            alive = {doc for queue in packer.waiting for doc, _, _ in queue}
            for doc in [d for d in ids if d not in alive]:
                del ids[doc], keys[doc]

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("key").type
            for at, size in _slices(batch):
                part = batch.slice(at, size)
                found = words.many([v or b"" for v in part.column("data").to_pylist()], p.end_id)
                for name, tokens in zip(part.column("key").to_pylist(), found, strict=True):
                    ids[given], keys[given] = tokens, name
                    packer.add(given, len(tokens))
                    given += 1
                    fresh += len(tokens)
                if fresh >= p.group_tokens:
                    packer.pack()
                    yield from emit(kind)
                    fresh = 0
        packer.finish()
        if packer.done:
            yield from emit(kind)
        _give_ids(kept, words, p.idle_seconds)

    inner = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    kind = inner.schema["key"].dataType.simpleString()
    return inner.mapInArrow(run, f"key {kind}, {PIECE_DDL}" + (", ids array<int>" if with_ids else "")).withColumnRenamed("key", key)


def _slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about ``size`` bytes of text."""
    lengths = batch.column("data")
    first = held = 0
    for i, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        held += n or 0
        if held >= size:
            yield first, i + 1 - first
            first, held = i + 1, 0
    if first < batch.num_rows:
        yield first, batch.num_rows - first


class _Kept:
    """Word ids that a worker process keeps from task to task, and drops when it has been without one for a while."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.held: dict[tuple, WordIds] = {}
        self.timer: threading.Timer | None = None

    def take(self, at: tuple) -> WordIds:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            found = self.held.pop(at, None)
            self.held.clear()
        return found or WordIds(*at)

    def give(self, at: tuple, words: WordIds, seconds: float) -> None:
        with self.lock:
            self.held[at] = words
            self.timer = threading.Timer(seconds, self.drop)
            self.timer.daemon = True
            self.timer.start()

    def drop(self) -> None:
        with self.lock:
            self.held.clear()


_KEPT = _Kept()


def _take_ids(at: tuple) -> WordIds:
    return _KEPT.take(at)


def _give_ids(at: tuple, words: WordIds, seconds: float) -> None:
    _KEPT.give(at, words, seconds)
