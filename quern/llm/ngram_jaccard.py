"""Exact n-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100; for sets of s and t shingles that means sharing at least
T(s, t) = ceil(percent * (s + t) / (100 + percent)) of them. The join finds them in steps:

1. Documents with equal sets form a class; classes, not copies, are joined.
2. Shingles are ordered by rising frequency, from a fixed-size sketch of all documents. A pair
   must meet in the first s - T + 1 shingles of either set, so only these are shuffled, as
   inverted lists. Frequent shingles (boilerplate) stand last and seldom lead a list.
3. Every class with another one of fitting size on one of its lists is indexed once, in the block of its
   most populated list and its band of sizes; and all but one class of each list ask, once in each
   block that their lists, sizes and positions point to. There DivideSkip (``divide_skip``) merges the
   short inverted lists of the query with a heap, skipping what cannot reach the required overlap,
   probes the long ones by binary search, and returns every document that reaches it.
4. In a block, what links count as one component from then on: a query is held against the most
   central document of each large component and then searches among all documents of other
   components. So a group of n near copies makes about n rows and not n * n pairs, and no pair of one component
   is looked at twice. Links of all blocks give the components.

``count_links`` has every class search among all others instead, and gives the number of classes that each one
links with: exact, without a row for any pair, in time that grows with the square of a group.

Texts are read three times: for the sketch, for the leading shingles, and to store, compressed,
those of classes that share a leading shingle with a class of fitting size. Only stored texts move.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.components import components
from quern.session import discard, stash


@dataclass(frozen=True)
class JaccardJoin:
    width: int = 5  # words of a shingle
    percent: int = 80
    sketch_bits: int = 19  # log2 of the sketch's counters, 4 bytes each
    block_shingles: int = 1_500_000  # of an index block, about
    block_queries: int = 20_000  # beyond which a block is split
    long_list: int = 64  # entries beyond which a list is probed rather than merged, as far as the threshold allows
    central: int = 8  # documents of a component from which on its most central one is tried first
    hot_list: int = 50_000  # occurrences from which on a shingle's list may be dealt out in parts
    salts: int = 64  # parts of such a list
    broadcast_rows: int = 200_000  # classes whose texts are wanted are broadcast up to this many

    def overlap(self, s, t):
        """The least number of common shingles of linked sets of s and t."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def probe(self, s):
        """Leading shingles of which a set of s has one in common with any linked set that is not larger."""
        return s - (-(-self.percent * s // 100)) + 1

    def index(self, s):
        """The same, for linked sets that are not smaller."""
        return s - self.overlap(s, s) + 1


# --- sets --------------------------------------------------------------------------------


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z count as a-z. A text with fewer words than
    ``width`` has one shingle, all its words."""
    hashes = W.word_hashes(data.lower())
    return W.distinct(W.grams(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def class_of(found: np.ndarray) -> int:
    """A set's class: a hash of its sorted shingles, as a signed long."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def slot_of(found: np.ndarray, bits: int) -> np.ndarray:
    """Counters of the frequency sketch."""
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def leading(found: np.ndarray, levels: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n shingles in the common order: by level of frequency, then by hash."""
    order = np.argsort(levels[slot_of(found, bits)], kind="stable")
    return found[order[:n]]


# --- T-occurrence search -----------------------------------------------------------------


class BlockIndex:
    """Inverted lists over the documents of a block."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.place = {name: i for i, name in enumerate(names)}
        self.names = names
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.docs = docs[order]  # the lists, one after another, each by rising document
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.keys = flat[first]
        self.bounds = np.append(first, len(flat))
        # (list, document) as one number, for binary probes.
        self.probes = np.repeat(np.arange(len(self.keys), dtype=np.int64), np.diff(self.bounds)) * max(1, len(sets)) + self.docs

    def lists(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the lists that the query's shingles have here."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        return at[self.keys[at] == query]

    def probe(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each document, on how many of the lists it stands, by binary search."""
        wanted = (lists[None, :] * max(1, len(self.names)) + docs[:, None]).ravel()
        hit = np.searchsorted(self.probes, wanted)
        hit[hit == len(self.probes)] = 0
        return (self.probes[hit] == wanted).reshape(len(docs), len(lists)).sum(axis=1)


def merge_skip(lists: list[list[int]], threshold: int) -> dict[int, int]:
    """Documents on at least ``threshold`` of the sorted lists, with how many. Lists are merged
    with a heap; whenever too few lists stand at the smallest document, those are moved on to
    the next document that could still reach the threshold."""
    heap = [(entries[0], i, 0) for i, entries in enumerate(lists) if entries]
    heapq.heapify(heap)
    out = {}
    while len(heap) >= threshold:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= threshold:
            out[doc] = len(popped)
            target = doc + 1
        else:
            for _ in range(threshold - 1 - len(popped)):
                if not heap:
                    break
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            entries = lists[i]
            while at < len(entries) and entries[at] < target:
                at += 1
            if at < len(entries):
                heapq.heappush(heap, (entries[at], i, at))
    return out


def divide_skip(index: BlockIndex, query: np.ndarray, wanted: np.ndarray, p: JaccardJoin, mu: float = 0.01) -> list[tuple[int, int]]:
    """(document, overlap) of the documents in ``wanted`` (rising numbers) that share enough shingles with the query."""
    if not len(wanted):
        return []
    least = int(p.overlap(len(query), index.sizes[wanted]).min())
    at = index.lists(query)
    if len(at) < least:
        return []
    begin, end = index.bounds[at], index.bounds[at + 1]
    length = end - begin
    by_length = np.argsort(length, kind="stable")
    longest = int(length.max())
    n_long = max(int(least / (mu * np.log2(longest + 1) + 1)), int((length > p.long_list).sum()))
    n_long = min(least - 1, n_long)
    short, long = by_length[: len(at) - n_long], by_length[len(at) - n_long :]
    # The short lists, without documents that are not wanted.
    n = length[short]
    ends = np.cumsum(n)
    flat = index.docs[np.repeat(begin[short] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    owner = np.repeat(np.arange(len(short)), n)
    mask = np.zeros(len(index.names), bool)
    mask[wanted] = True
    keep = mask[flat]
    flat, owner = flat[keep].tolist(), owner[keep].tolist()
    lists: list[list[int]] = []
    last = -1
    for doc, i in zip(flat, owner, strict=True):
        if i != last:
            lists.append([])
            last = i
        lists[-1].append(doc)
    found = merge_skip(lists, max(1, least - n_long))
    out = []
    for doc, count in found.items():
        need = int(p.overlap(len(query), index.sizes[doc]))
        if count + n_long < need:
            continue
        count += int(index.probe(at[long], np.array([doc]))[0])
        if count >= need:
            out.append((doc, count))
    return out


class Search:
    """Searches of a block. Documents that a link joins are one component from then on."""

    def __init__(self, index: BlockIndex, p: JaccardJoin):
        self.index, self.p = index, p
        n = len(index.names)
        self.root = np.arange(n + 1)  # the last stands for a query that the block has not
        self.members, self.centre = np.ones(n + 1, np.int64), np.arange(n + 1)
        length = np.diff(index.bounds)
        #: How populated the lists of a document are: a component's centre is the one with most company.
        self.weight = np.append(np.bincount(index.docs, weights=np.repeat(length, length), minlength=n) / np.maximum(1, index.sizes), 0.0)

    def _fits(self, n: int) -> np.ndarray:
        sizes, p = self.index.sizes, self.p
        return (p.percent * sizes <= 100 * n) & (p.percent * n <= 100 * sizes)

    def _join(self, one: int, two: int) -> None:
        """One component of two; the larger one's name stays, and never that of an outsider alone."""
        here, there = (one, two) if self.members[one] < self.members[two] or one == len(self.index.names) else (two, one)
        self.root[self.root == here] = there
        self.members[there] += self.members[here]
        if self.weight[self.centre[here]] > self.weight[self.centre[there]]:
            self.centre[there] = self.centre[here]

    def links(self, query: np.ndarray, cls: int) -> list[tuple[int, int]]:
        """(document, overlap): a link to each component that has any with the query."""
        index, p, n = self.index, self.p, len(query)
        own = index.place.get(cls, len(index.names))
        if own == len(index.names):
            # An outsider joins what it links with, and leaves no mark but those links.
            if self.root[-1] != own:
                self.members[self.root[-1]] -= 1
            self.root[-1], self.members[-1] = own, 1
        fits = self._fits(n)
        out = []

        def join(docs: list[tuple[int, int]]) -> None:
            for doc, count in docs:
                if self.root[own] != self.root[doc]:
                    self._join(self.root[own], self.root[doc])
                    out.append((doc, count))

        roots = np.unique(self.root[:-1])
        centres = self.centre[roots[self.members[roots] >= p.central]]
        centres = centres[centres < len(index.names)]
        centres = centres[fits[centres] & (self.root[centres] != self.root[own])]
        if len(centres):
            counts = index.probe(index.lists(query), centres)
            join([(d, c) for d, c in zip(centres.tolist(), counts.tolist(), strict=True) if c >= p.overlap(n, index.sizes[d])])
        join(divide_skip(index, query, np.flatnonzero(fits & (self.root[:-1] != self.root[own])), p))
        return out

    def count(self, query: np.ndarray, cls: int) -> int:
        """How many documents other than the query's own class link with it."""
        wanted = self._fits(len(query))
        if (own := self.index.place.get(cls)) is not None:
            wanted[own] = False
        return len(divide_skip(self.index, query, np.flatnonzero(wanted), self.p))


# --- passes over texts -------------------------------------------------------------------


def _profile(docs: DataFrame, p: JaccardJoin, key: str, text: str) -> DataFrame:
    """id, n, cls of every document, and rows with the counters of each task's sketch; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << p.sketch_bits, np.uint32), set()
        slots: list[np.ndarray] = []
        for batch in batches:
            sizes, classes, held = [], [], 0
            for data in W.binary_column(batch, "data"):
                found = shingles(data, p.width)
                cls = class_of(found) if len(found) else None
                sizes.append(len(found))
                classes.append(cls)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    slots.append(slot_of(found, p.sketch_bits))
                    held += len(found)
                if held > 1 << 20:
                    counts += np.bincount(np.concatenate(slots), minlength=len(counts)).astype(np.uint32)
                    slots, held = [], 0
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=len(counts)).astype(np.uint32)
                slots = []
            empty = pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), empty], ["id", "n", "cls", "sketch"])
        if seen:
            packed = zstandard.ZstdCompressor(level=1).compress(counts.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([min(seen)], pa.int64()), pa.array([packed], pa.binary())], ["id", "n", "cls", "sketch"])

    return stash(_texts(docs, key, text).mapInArrow(run, "id bigint, n bigint, cls bigint, sketch binary"), "jaccard-profile")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))


def _levels(profile: DataFrame, p: JaccardJoin) -> np.ndarray:
    """The sum of all sketches as levels, 2048 to a doubling. It is of fixed size (2^sketch_bits
    counters); tasks add up sketches, and at most 16 sums reach the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << p.sketch_bits, np.uint64)
        for batch in batches:
            for value in batch.column("sketch").to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], ["sketch"])

    parts = profile.filter("sketch is not null").select("sketch").repartition(16).mapInArrow(add, "sketch binary").collect()
    total = sum((np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.sketch)), np.uint64) for r in parts), np.zeros(1 << p.sketch_bits, np.uint64))
    return np.minimum(np.log2(total.astype(np.float64) + 1) * 2048, 65535).astype(np.uint16)


def _postings(docs: DataFrame, levels: np.ndarray, p: JaccardJoin, key: str, text: str) -> DataFrame:
    """token, salt, cls, sp (size << 32 | position): the leading shingles of every class, once per task that has it. Shingles
    whose counter is beyond ``hot_list`` have one of ``salts`` by their class; a counter has at least the true number."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2 bytes a counter
    counts = np.exp2(levels / 2048.0)
    hot = np.log2(max(p.hot_list, 64 * float(counts.mean()))) * 2048

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, salts, classes, places, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                arrays = [np.concatenate(tokens).view(np.int64), np.concatenate(salts), np.concatenate(classes), np.concatenate(places)]
                return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "salt", "cls", "sp"])

            for data in W.binary_column(batch, "data"):
                found = shingles(data, p.width)
                if not len(found) or (cls := class_of(found)) in seen:
                    continue
                seen.add(cls)
                first = leading(found, shared.value, p.sketch_bits, p.probe(len(found)))
                tokens.append(first)
                salts.append(np.where(shared.value[slot_of(first, p.sketch_bits)] > hot, 1 + cls % p.salts, 0))
                classes.append(np.full(len(first), cls, np.int64))
                places.append((len(found) << 32) + np.arange(len(first), dtype=np.int64))
                held += len(first)
                if held > 1 << 17:
                    yield out()
                    tokens, salts, classes, places, held = [], [], [], [], 0
            if held:
                yield out()

    return _texts(docs, key, text).select("data").mapInArrow(run, "token bigint, salt bigint, cls bigint, sp bigint")


LIST_DDL = "token bigint, cls bigint, size bigint, pos bigint"


def _lists(postings: DataFrame) -> DataFrame:
    """LIST_DDL: the rows of all lists with more than one class, each class once. Rows stream; one is held between
    batches. A list with a salt is dealt out in parts, all of whose rows are given, though a part may have one class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        shown = False  # the held row's list has other rows

        def out(table: np.ndarray) -> pa.RecordBatch:
            arrays = [table[:, 0], table[:, 3], table[:, 2] >> 32, table[:, 2] & 0xFFFFFFFF]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [f.split()[0] for f in LIST_DDL.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in ("token", "salt", "sp", "cls")])])
            # A class that several tasks have is adjacent to itself.
            table = table[np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])]
            same = (table[1:, :2] == table[:-1, :2]).all(axis=1)
            several = np.concatenate([[shown], same]) | np.concatenate([same, [False]]) | (table[:, 1] > 0)
            # All rows but the last are shown; the last may still get company.
            if several[:-1].any():
                yield out(table[:-1][several[:-1]])
            held, shown = table[-1:], bool(several[-1])
        if len(held) and shown:
            yield out(held)

    ordered = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "sp", "cls")
    return stash(ordered.mapInArrow(run, LIST_DDL), "jaccard-lists")


# --- verification ------------------------------------------------------------------------


def _store(docs: DataFrame, reps: DataFrame, wanted: DataFrame, p: JaccardJoin, key: str, text: str) -> DataFrame:
    """cls, n, z (compressed text of one document) of the classes in ``wanted``."""
    wanted = stash(wanted.distinct().join(reps, "cls").select("cls", "n", F.col("rep").alias("to")), "jaccard-wanted")
    small = wanted.count() <= p.broadcast_rows
    width = p.width

    # Rows of other texts may share the id, so every text is held against its class.
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keep, packed = [], []
            for cls, data in zip(batch.column("cls").to_pylist(), W.binary_column(batch, "data"), strict=True):
                keep.append(class_of(shingles(data, width)) == cls)
                packed.append(packer.compress(data) if keep[-1] else None)
            rows = pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(packed, pa.binary())], ["cls", "n", "z"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(d) for d in W.binary_column(batch, "data")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "z"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            same = [class_of(shingles(reader.decompress(z), width)) == c for z, c in zip(batch.column("z").to_pylist(), batch.column("cls").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    texts = _texts(docs, key, text)
    to = F.col("id").eqNullSafe(F.col("to"))
    ddl = "cls bigint, n bigint, z binary"
    if small:
        rows = texts.join(F.broadcast(wanted), to).select("cls", "n", "data").mapInArrow(pack, ddl)
    else:
        packed = texts.mapInArrow(squeeze, "id bigint, z binary")
        rows = packed.join(wanted.hint("shuffle_hash"), to).select("cls", "n", "z").mapInArrow(check, ddl)
    out = stash(rows, "jaccard-store")
    discard(wanted)
    return out


def _query_parts(p: JaccardJoin) -> Column:
    """Into how many parts the queries (n: their sizes) of a block go."""
    return (F.greatest(F.floor(F.count("*") / p.block_queries), F.floor(F.sum("n") / p.block_shingles)) + 1).cast("int").alias("parts")


def _search_blocks(index: DataFrame, queries: DataFrame, p: JaccardJoin, exact: bool) -> DataFrame:
    """a, b, overlap: what queries (a) link with in their blocks, a document (b) of each component; or, ``exact``, a, null and the
    number of documents that it links with there. Both tables have block, part, role (0: index, 1: query), cls, z."""
    rows = index.unionByName(queries).repartition("block", "part").sortWithinPartitions("block", "part", "role")
    width = p.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, here = zstandard.ZstdDecompressor(), None
        names: list[int] = []
        sets: list[np.ndarray] = []
        known: set[int] = set()
        search: Search | None = None
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("block", "part", "role", "cls", "z")]
            for at_block, part, role, cls, z in zip(*columns, strict=True):
                if (at_block, part) != here:
                    here, names, sets, known, search = (at_block, part), [], [], set(), None
                if role == 1 and not names:
                    continue
                own = shingles(reader.decompress(z), width)
                if role == 0:
                    if cls not in known:
                        known.add(cls)
                        names.append(cls)
                        sets.append(own)
                    continue
                if search is None:
                    search = Search(BlockIndex(names, sets), p)
                    sets = []
                if exact:
                    found.append((cls, None, search.count(own, cls)))
                else:
                    found += [(cls, names[doc], count) for doc, count in search.links(own, cls)]
            columns = list(zip(*found, strict=True)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "overlap"])

    return rows.mapInArrow(run, "a bigint, b bigint, overlap bigint")


# --- the join ----------------------------------------------------------------------------


def _prepared(docs: DataFrame, p: JaccardJoin, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, n, cls of all rows; cls, n, smallest id of all classes; rows of lists that another class fits; stored texts of those)."""
    profile = _profile(docs, p, key, text)
    rows = profile.filter("sketch is null").drop("sketch")
    reps = rows.filter("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.min("id").alias("rep"))
    lists = _lists(_postings(docs, _levels(profile, p), p, key, text))
    near = stash(_near(lists, p), "jaccard-near")
    discard(lists)
    return rows, reps, near, _store(docs, reps, near.select("cls"), p, key, text)


def join(docs: DataFrame, p: JaccardJoin = JaccardJoin(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    Documents: doc_id, n_shingles, component_id (the smallest id that links lead to), class_id of
    every row. Links: a, b (classes), overlap; enough of them to connect every component: of a group
    of many near copies that is a small part of all (``count_links`` has their number).

    A text that is null or has no word has no shingle and links with nothing: its component is
    its own id. Rows with equal sets are one class, whatever their ids; rows may repeat. Ids
    are integers; a null id counts as a row but never names a component of others. Other
    columns are not read; an empty table gives an empty one. Sets are compared by 64-bit
    hashes of their shingles.
    """
    rows, reps, near, store = _prepared(docs, p, key, text)
    links = _searched(near, store, p)
    discard(near, store)
    labels = components(links.select("a", "b"))
    named = reps.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = stash(named.join(smallest, "label").select("cls", "component_id"), "jaccard-classes")
    discard(labels)
    documents = rows.join(classes.withColumnRenamed("cls", "to_cls"), F.col("cls") == F.col("to_cls"), "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("cls").alias("class_id")
    )
    return documents, links


def count_links(docs: DataFrame, p: JaccardJoin = JaccardJoin(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id and n_links of every row: the number of other classes that its class links with, every one
    searched for and verified. Nulls, repeats and empty tables as in ``join``."""
    rows, _, near, store = _prepared(docs, p, key, text)
    found = _searched(near, store, p, exact=True)
    discard(near, store)
    counts = found.groupBy("a").agg(F.sum("overlap").alias("n_links"))
    counted = rows.join(counts, F.col("cls") == F.col("a"), "left")
    return counted.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Sizes of a band differ by less than a quarter.
_BAND = "cast(floor(ln(size) / ln(1.25)) as int)"


def _groups(p: JaccardJoin) -> list[Column]:
    """What ``_fits`` needs to know of a group of rows of one list."""
    left = F.col("size") - F.col("pos")  # shingles from the list's on
    return [
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(left).alias("room"), F.max(F.when(F.expr(_lead(p)), left)).alias("lead_room"),
    ]


def _lead(p: JaccardJoin) -> str:
    return f"pos < size - (({2 * p.percent} * size + {99 + p.percent}) div {100 + p.percent}) + 1"  # JaccardJoin.index


def _fits(p: JaccardJoin) -> Column:
    """Whether a row (size, pos) of a list may link, by sizes and positions, with one of a group of its rows:
    with one that is not larger, if that leads the list, or one that is not smaller, if this does."""
    q = p.percent
    enough = f"least(size - pos, {{room}}) * {100 + q} >= {q} * (size + greatest(lo, {{least}}))"
    smaller = f"(100 * hi >= {q} * size and lo <= size and lead_room is not null and {enough.format(room='lead_room', least=f'({q} * size + 99) div 100')})"
    larger = f"({_lead(p)} and hi >= size and 100 * size >= {q} * lo and {enough.format(room='room', least='size')})"
    return F.expr(f"{smaller} or {larger}")


def _near(lists: DataFrame, p: JaccardJoin) -> DataFrame:
    """token, cls, size, pos: the rows that another class of their list fits. Where two classes link, their rows
    on the first list that they share are among these."""
    rows = lists.select("token", "cls", "size", "pos")
    groups = rows.groupBy("token", F.expr(_BAND).alias("band")).agg(*_groups(p), F.min("cls").alias("lo_cls"), F.max("cls").alias("hi_cls"))
    groups = groups.select(F.col("token").alias("to_token"), "lo", "hi", "room", "lead_room", "lo_cls", "hi_cls")
    others = "token = to_token and (lo_cls <> cls or hi_cls <> cls)"
    return rows.join(groups, F.expr(others) & _fits(p), "left_semi")


def _searched(near: DataFrame, store: DataFrame, p: JaccardJoin, exact: bool = False) -> DataFrame:
    """a, b, overlap: links enough to join all classes that links connect; or, ``exact``, the links of each class in each of its blocks."""
    per = near.groupBy("token").agg(F.max("cls").alias("asked"), F.count("*").alias("members"))
    home = near.join(per, "token").groupBy("cls").agg(F.max_by("token", F.struct("members", "token")).alias("home"))
    rows = near.join(home, "cls").withColumn("band", F.expr(_BAND))
    rows = stash(rows, "jaccard-open")
    groups = rows.groupBy("token", "home", "band").agg(*_groups(p), F.min("cls").alias("lo_cls"), F.max("cls").alias("hi_cls"))
    groups = groups.withColumnsRenamed({"token": "to_token", "home": "to_home", "band": "to_band"})
    others = "token = to_token and (lo_cls <> cls or hi_cls <> cls)"
    # A list's last class need not ask: all others ask for it. To count, it has to.
    asking = rows if exact else rows.join(per.select(F.col("token").alias("at"), "asked"), F.expr("token = at and cls = asked"), "left_anti")
    routes = asking.join(groups, F.expr(others) & _fits(p))
    routes = routes.select("cls", F.col("size").alias("n"), F.col("to_home").alias("home"), F.col("to_band").alias("band")).distinct()
    routes = stash(routes, "jaccard-routes")
    classes = rows.select("cls", F.col("size").alias("n"), "home", "band").distinct()
    blocks = routes.groupBy("home", "band").agg(_query_parts(p)).join(
        classes.groupBy("home", "band").agg((F.floor(F.sum("n") / p.block_shingles) + 1).cast("int").alias("shards")), ["home", "band"]
    )
    blocks = stash(blocks, "jaccard-blocks")
    texts = store.select("cls", "z")

    def dealt(side: DataFrame, role: int) -> DataFrame:
        """A query goes to one part of every shard of its block, an index document to every part of its shard."""
        own, every = ("parts", "shards") if role else ("shards", "parts")
        mine = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int").alias("mine")
        side = side.join(blocks, ["home", "band"]).select("cls", "home", "band", mine, F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias("each"))
        shard, part = ("each", "mine") if role else ("mine", "each")
        return side.join(texts, "cls").select(F.xxhash64("home", "band", shard).alias("block"), F.col(part).alias("part"), F.lit(role).alias("role"), "cls", "z")

    found = stash(_search_blocks(dealt(classes, 0), dealt(routes, 1), p, exact), "jaccard-links")
    discard(rows, routes, blocks)
    return found


def keep_one(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Rows that repeat
    that id and its set all stay, as do documents without words and those with a null id that
    link with nothing."""
    documents, _ = join(docs, p)
    kept = documents.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("to_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("to_id")), "left_semi").select("row.*")


def report(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    return join(docs.select("doc_id", "text"), p)[0]
